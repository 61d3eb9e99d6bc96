"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontam, langid, license, mixing, neardup, quality_clf, quality_rules, queries, secrets, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "web", 3), (4, LONG, "en", "web", len(LONG)), (5, "plain words here", "en", "web", 16),
    (5, "plain words here", "en", "web", 16), (None, "a row without an id", "en", None, 19), (7, "déjà vu ½ ﬁn 中文", "fr", "b`c", 15),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column whose name clashes with what operators make."""
    return spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("id", F.lit(0)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(t):
    return WORD.findall(t or "")


# --- 1 mixing -----------------------------------------------------------------------------------------------------


def test_mixing_by_hand(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 11 else None) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(d).collect()
    size = Counter()
    for i, t, s in rows:
        size[s] += len(words(t))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted((s for s in size if s), key=str) + [None])}
    left, target, open_ = float(sum(size.values())), {}, set(size)
    while open_:  # shares by weight; whoever is above its cap gets the cap, and the rest is shared anew
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == size[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()), key=str)


def test_mixing_order_is_by_virtual_finish(spark, docs):
    out = mixing.mix(docs).select("virtual_finish").collect()
    assert [r[0] for r in out] == sorted(r[0] for r in out)


def test_mixing_edges(odd, empty):
    out = mixing.mix(odd)
    assert out.count() == len(ODD) and out.where("doc_id = 1").first()["size"] == 0
    assert mixing.mix(empty).count() == 0
    some = mixing.mix(odd, carry=["doc_id", "size", "text"])
    assert some.columns == ["doc_id", "size", "text", "size_", "source_size", "target", "taken", "weight", "virtual_finish"] and {r["size"] for r in some.collect()} == {"clash"}


def test_mixing_serves_slices_in_the_global_order(spark):
    """Brute force: all slices of all passes sorted by virtual finish and source, taken until the budget is spent."""
    r = random.Random(6)
    rows = [(i, "w " * r.choice([0, 1, 3, 50, 400]), r.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for weights, share in ((None, 1.0), ({"a": 5.0, "b": 0.5, None: 0.01}, 0.7), ({"a": 1.0}, 1.0)):
        queue = {}
        for i, t, s in sorted(rows, key=lambda x: hashlib.md5(f"{x[0]} {x[1]}".encode()).hexdigest()):
            queue.setdefault(s, []).append((i, len(words(t))))
        weight = {s: float(k % 3 + 1) for k, s in enumerate(sorted(x for x in queue if x) + [None])} if weights is None else {s: weights.get(s, 0.0) for s in queue}
        slices = []
        for s, own in queue.items():
            at = 0
            for _ in range(3):
                for i, n in own:
                    for _ in range(n):
                        at += 1
                        if weight[s] > 0:
                            slices.append((at / weight[s], s is None, s or "", i))
        budget = int(share * sum(n for own in queue.values() for _, n in own) + 1e-9)
        want = Counter(i for *_, i in sorted(slices)[:budget])
        got = {x.doc_id: x.taken for x in mixing.mix(d, weights=weights, share=share).collect()}
        assert got == {i: want[i] for i, _, _ in rows}


# --- 2 tokens -----------------------------------------------------------------------------------------------------


def greedy(pieces, s):
    known, n, at = set(pieces), 0, 0
    while at < len(s):
        end = next((e for e in range(len(s), at, -1) if s[at:e] in known), None)
        n, at = (n + 1, end) if end else (n + len(s[at].encode()), at + 1)
    return n


def test_automaton_is_greedy():
    r = random.Random(5)
    for _ in range(200):
        pieces = list({"".join(r.choice("abc▁") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))})
        auto = tokens.Automaton(pieces)
        for _ in range(20):
            s = "".join(r.choice("abcdé▁") for _ in range(r.randint(0, 14)))
            assert auto.count(s) == greedy(pieces, s), (pieces, s)


def test_tokens_of_documents(spark, sf, texts):
    """Every document of the query, whole, against greedy cutting."""
    known = {p: None for p in tokens.load_pieces()}
    longest, memo = max(map(len, known)), {}

    def cut(w):
        s, n, at = tokens.START + w, 0, 0
        while at < len(s):
            end = next((e for e in range(min(len(s), at + longest), at, -1) if s[at:e] in known), None)
            n, at = (n + 1, end) if end else (n + len(s[at].encode()), at + 1)
        return n

    got = queries.op2_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = words(texts[r.doc_id])
        assert (r.n_words, r.n_tokens) == (len(own), sum(memo[w] if w in memo else memo.setdefault(w, cut(w)) for w in own)), r.doc_id


def test_tokens_edges(odd, empty):
    out = tokens.count_tokens(odd)
    assert out.count() == len(ODD) and {tuple(r) for r in out.where("doc_id in (1, 2, 3)").select("n_words", "n_tokens").collect()} == {(0, 0)}
    assert tokens.count_tokens(empty).count() == 0


# --- 3 decontamination ----------------------------------------------------------------------------------------------

ITEM = "A train travels 60 km in 3 hours from Lyon to Paris. How many km does the train travel in one day at the same speed?"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None)], "item_id bigint, text string")
    rows = [
        (1, "Some words before. " + ITEM + " And after."), (2, ITEM.replace("60", "75").replace("3 hours", "5 hours").replace("Lyon", "Nice").replace("Paris", "Rome")), (3, "A train may be late in the morning, and how many people wait for it nobody knows."),
        (4, None), (5, ""), (6, "too short"), (7, ITEM.upper()),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in decontam.find_contamination(d, bench).collect()}
    assert {1, 2} <= set(got) <= {1, 2, 7} and got[2].changed_slots >= 2 and got[1].coverage == 1.0
    assert {r.doc_id for r in decontam.drop_contaminated(d, bench).collect()} == {i for i, _ in rows} - set(got)


def test_decontamination_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "Anna has 4 apples and Anna gives 4 apples to the boy who has 4 apples in the blue bag")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "Anna has 9 apples and Anna gives 9 apples to the boy who has 9 apples in the blue bag"), (2, "Anna has 9 apples and Anna gives 2 apples to the boy who has 5 apples in the blue bag")], "doc_id bigint, text string")
    assert {r.doc_id for r in decontam.find_contamination(d, bench).collect()} == {1}


def test_decontamination_new_values_may_coincide(spark):
    """Two slots with the same new value, and short or name-dense items with all names changed, are found; one value for two is not enough."""
    items = [
        (1, "The man sells 3 apples and 5 pears at the market each day"), (2, "Tom gave Mary 5 apples in Paris"),
        (3, "Tom Smith, Mary Jones and Ann gave Bob Brown, Joe Green and Sue coins"), (4, "7 8 or 6 9 2 3 and 4 1 5 but 2"),
    ]
    rows = [
        (1, "So. The man sells 4 apples and 4 pears at the market each day", 1), (1, "So. The man sells 4 apples and 6 pears at the market each day", 1), (2, "Once Jim gave Lucy 9 apples in Rome today", 2),
        (3, "so Max Miller, Eve Adams and Kim gave Ted White, Lee Black and Zoe coins", 3), (4, "1 2 or 3 4 5 6 and 7 8 9 but 5", 4),
        (5, "Once Jim gave Lucy nine pears in Rome today", None), (5, "some apples in Rome, gave Jim", None),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contamination(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, k) for i, (_, _, k) in enumerate(rows) if k}


def test_decontamination_finds_whole_items(spark, sf, texts):
    """Brute force: an item whose text stands in a document word for word is found."""
    found = {(r.doc_id, r.item_id) for r in queries.op3_decontaminate(spark, sf).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert planted and planted <= found


def brute_templates(items, docs):
    """(doc, item) pairs by the docstring's rule, with strings for windows and every place of every document tried."""
    need = decontam.LITERALS

    def readings(text):
        tokens = decontam.TOKEN.findall(text or "")
        low = [t.lower() for t in tokens]
        number = [t[0].isdigit() or w in decontam.NUMBERS for t, w in zip(tokens, low)]
        plain, named = [], []
        for i, (t, w) in enumerate(zip(tokens, low)):
            unit = w in decontam.UNITS and not number[i]
            beside = unit and (i > 0 and number[i - 1] or i + 1 < len(tokens) and number[i + 1])
            plain.append("<number>" if number[i] else "<unit>" if beside else w)
            named.append("<name>" if t[0].isupper() and not number[i] and not unit else plain[-1])
        return tokens, plain, named

    literals = lambda window: sum(not x.startswith("<") for x in window)

    def shortest(reading, least):
        return next((n for n in range(least, len(reading) + 1) if max(literals(reading[i : i + n]) for i in range(len(reading) - n + 1)) >= min(need, n)), None)

    known = []
    for k, text in items:
        tokens, plain, named = readings(text)
        if len(tokens) < need or (n := shortest(plain, min(decontam.WINDOW, len(tokens)))) is None:
            continue
        look = {(n, 0, tuple(plain[i : i + n])): [] for i in range(len(plain) - n + 1) if literals(plain[i : i + n]) >= min(need, n)}
        for m in {n, shortest(named, n)} - {None}:
            look |= {(m, 1, tuple(named[i : i + m])): [] for i in range(len(named) - m + 1) if literals(named[i : i + m]) >= min(need, m)}
        for m, r, w in look:
            reading = (plain, named)[r]
            look[m, r, w] = [i for i in range(len(reading) - m + 1) if tuple(reading[i : i + m]) == w]
        starts = [i for i in range(len(plain) - n + 1) if literals(plain[i : i + n]) >= min(need, n)]
        renamed = {i for i in range(len(named) - n + 1) if literals(named[i : i + n]) >= min(need, n)}
        known.append((k, tokens, plain, named, n, look, starts, renamed))
    out = set()
    for d, text in docs:
        tokens, plain, named = readings(text)
        for k, own, ip, iname, n, look, starts, renamed in known:
            shifts = {at - i for m, r, w in look for at in range(len(tokens) - m + 1) if tuple((plain, named)[r][at : at + m]) == w for i in look[m, r, w]}
            found = set()
            for shift in sorted(shifts):
                stands = {}
                ok = []
                for i in starts:
                    if 0 <= i + shift and i + shift + n <= len(tokens):
                        p = [ip[j] == plain[j + shift] for j in range(i, i + n)]
                        if all(x or iname[j] == named[j + shift] for x, j in zip(p, range(i, i + n))):
                            ok.append((not all(p) and i not in renamed, i, not all(p)))
                for _, i, as_names in sorted(ok):
                    fresh = {}
                    good = True
                    for x, y in zip(own[i : i + n], tokens[i + shift : i + shift + n]):
                        a, b = x.lower(), y.lower()
                        slot = a != b or a[0].isdigit() or a in decontam.NUMBERS or as_names and x[0].isupper()
                        if slot and fresh.setdefault(a, b) != b:
                            good = False
                            break
                    if good and all(stands.get(a, b) == b for a, b in fresh.items()):
                        stands.update(fresh)
                        found.add(i)
            share = len(found) / len(starts)
            if 2 * len(renamed) >= len(starts) >= 2 * need:
                share = max(share, len(found & renamed) / len(renamed))
            if share >= decontam.THRESHOLD:
                out.add((d, k))
    return out


def test_decontamination_brute_force(spark, sf, texts):
    """All documents and items, with planted items whose numbers and names are changed, alike or not, against every place tried; clean documents have no hit."""
    r = random.Random(13)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(1000, ITEM), (1001, "Anna buys 3 apples for 2 dollars and Bob buys 7 pears for 9 dollars at the same shop in Rome"), (1002, "what is the sum of 12 and 30 if both are doubled first"), (1003, "Paris Rome 1 2")]
    docs = [(i, " ".join((t or "").split()[:400])) for i, t in list(texts.items())[:60]]
    for n, (_, text) in enumerate(items):
        for how in range(4):
            new = {}
            def change(m, new=new, how=how):
                w = m[0]
                if how == 0:
                    return w
                if how == 3:  # every place anew
                    return str(r.randint(2, 99)) if w.isdigit() else w
                return new.setdefault(w, str(r.randint(2, 99)) if w.isdigit() else r.choice(["Kim", "Oslo", "Ada", "Lima"]) if how == 2 else w)
            docs.append((10_000 + 10 * n + how, "some words before it. " + re.sub(r"\b(?:\d+|[A-Z][a-z]+)\b", change, text) + " and some after"))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.find_contamination(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute_templates(items, docs)
    assert got == want
    assert {(10_000 + 10 * n, k) for n, (k, _) in enumerate(items) if k not in (1003,)} <= got and (10_000 + 10 * (len(items) - 4) + 1, 1000) in got
    clean = [(i, t) for i, t in docs if i < 10_000 and not any(text[:40] in t for _, text in items)]
    assert clean and not {i for i, _ in clean} & {i for i, k in got if k >= 1000}


def test_decontamination_in_blocks(spark, monkeypatch):
    """A benchmark of several blocks gives what one block gives."""
    items = [(i, ITEM.replace("60", str(i)).replace("speed", f"s{'abcdefgh'[i]}peed") + " " + " ".join(f"{'abcdefgh'[i]}{c}word" for c in "abcdefghij")) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame([(i, "before " + t.replace("hours", "days")) for i, t in items] + [(9, "nothing of it")], "doc_id bigint, text string")
    whole = sorted(map(tuple, decontam.find_contamination(d, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 60)
    assert sorted(map(tuple, decontam.find_contamination(d, bench).collect())) == whole and {r[:2] for r in whole} >= {(i, i) for i in range(8)}
    assert [r.doc_id for r in decontam.drop_contaminated(d, bench).collect()] == [9]


def test_decontamination_edges(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert decontam.find_contamination(odd, none).count() == 0 and decontam.find_contamination(empty, bench).count() == 0
    named = spark.createDataFrame([("x", ITEM)], "item_id string, text string")
    texts = spark.createDataFrame([("a", ITEM, True), (None, None, None)], "doc_id string, text string, hit boolean")
    assert [(r.doc_id, r.item_id) for r in decontam.find_contamination(texts, named).collect()] == [("a", "x")] and decontam.drop_contaminated(texts, named).collect() == [(None, None, None)]
    assert decontam.drop_contaminated(odd, bench).count() == len(ODD) and decontam.drop_contaminated(odd, bench).columns == odd.columns


# --- 4 language ---------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", tokens.START, tokens.START + "a", "aba"]
    table = langid.Pieces(pieces)
    r = np.random.default_rng(1)
    p = r.random((table.size, 2))
    ids = {x: k + 1 for k, x in enumerate(pieces)}

    def ways(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for e in range(1, len(s) + 1):
            if s[:e] in ids or e == 1:
                total = total + p[ids.get(s[:e], 0)] * ways(s[e:])
        return total

    some = ["aba", "b", "abab", "c", "acb"]
    assert np.allclose(np.exp(langid.forward(some, table, p)), [ways(tokens.START + w) for w in some])


def test_language_accuracy(spark, sf):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) / len(held) > 0.95


def test_language_brute_force(spark, sf, texts):
    """The whole query against sums over all segmentations in plain Python, under the fitted model; and rows that are held out teach it nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    langs, p, pieces = langid.fit(train)
    number = {x: k + 1 for k, x in enumerate(pieces) if 0 < len(x) <= langid.LONGEST}
    memo = {}

    def logs(word):
        if word not in memo:
            s = tokens.START + word
            ways = [np.ones(len(langs))] + [np.zeros(len(langs)) for _ in s]
            for e in range(1, len(s) + 1):
                for b in range(max(0, e - langid.LONGEST), e):
                    if s[b:e] in number or e == b + 1:
                        ways[e] = ways[e] + ways[b] * p[number.get(s[b:e], 0)]
            memo[word] = np.log(np.maximum(ways[-1], 1e-300))
        return memo[word]

    got = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        own = [u for u in map(langid.unit, langid.LETTERS.findall((t or "").lower())) if u]
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        s = sum(logs(w) for w in own)
        e = np.exp(s - s.max())
        best = np.sort(e)[::-1]
        assert got[i].score == pytest.approx(1 / e.sum(), abs=1e-3) and (got[i].lang_pred == langs[int(s.argmax())] or best[1] > 0.999)
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    again = langid.fit(other.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    assert again[0] == langs and np.array_equal(again[1], p)


def test_language_edges(spark, odd, empty):
    model = langid.fit(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and model[0] == ["en", "fr"] and got[7][0] == "fr"
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


# --- 5 rules ------------------------------------------------------------------------------------------------------


def base_measures(t):
    t = t or ""
    own = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    n, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            marked |= {i, i + 1, i + 2}
    return len(own), sum(map(len, own)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_rules_measures(spark, sf, texts, odd):
    got = queries.op5_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality_rules.quality_rules(odd, labels).collect()
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter(base_measures(x[1]) for x in ODD)
    assert all(r.kept != r.base_failed for r in out)


def test_rules_random_texts(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice(["a", "b", "é", " ", "\n", "\t", "#", "  "]) for _ in range(r.randint(0, 80)))) for i in range(300)]
    m = quality_rules.measured(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for x in m.collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_measures(rows[x.doc_id][1])


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 10, 200) for k in (0, 1, n // 2)]
    d = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", quality_rules.binomial_tail("k", "n", 0.02).alias("p"))
    for k, n, p in d.collect():
        assert p == pytest.approx(sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)))


def test_rules_guarantee(spark):
    """Cutoffs lose few good documents; junk goes; with few labels nothing goes beyond the base rules."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(900)]
    good = [(i, " ".join(r.choice(vocabulary) for _ in range(80))) for i in range(3000)]
    bad = [(i, " ".join(r.choice(vocabulary) + "#$%&" for _ in range(80))) for i in range(3000, 3300)]
    d = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i, _ in good + bad], "doc_id bigint, quality int")
    out = quality_rules.quality_rules(d, labels).collect()
    assert sum(not x.kept for x in out if x.doc_id < 3000) <= 0.02 * 3000 and not any(x.kept for x in out if x.doc_id >= 3000)
    few = quality_rules.quality_rules(d, labels.limit(20)).collect()
    assert all(x.kept != x.base_failed for x in few)


def test_rules_few_labels_suffice(spark):
    """A few hundred good documents give a stratum its cutoffs, if a rule rejects none of them; junk without a label goes, too."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(900)]
    good = [(i, " ".join(r.choice(vocabulary) for _ in range(80))) for i in range(320)]
    bad = [(i, " ".join(r.choice(vocabulary) + "#" * (k % 2) for k in range(80))) for i in range(320, 380)]
    d = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 320)) for i, _ in good + bad[:30]], "doc_id bigint, quality int")
    out = quality_rules.quality_rules(d, labels).collect()
    assert sum(not x.kept for x in out if x.doc_id < 320) <= 0.02 * 320 and not any(x.kept for x in out if x.doc_id >= 320)
    assert quality_rules.least_good() == 203
    assert quality_rules.least_good(strata=1) == 149 and quality_rules.merged({"short": 20, "middle": 300, "long": 2}, 0.02, 0.05) == [("short", "middle", "long")]
    assert quality_rules.merged({"short": 300, "middle": 300, "long": 300}, 0.02, 0.05) == [("short",), ("middle",), ("long",)] and quality_rules.merged({"short": 300, "middle": 200, "long": 90}, 0.02, 0.05) == [("short",), ("middle", "long")]
    fewer = quality_rules.quality_rules(d, labels.where("doc_id < 150 or doc_id >= 320")).collect()
    assert all(x.kept != x.base_failed for x in fewer)


def test_rules_brute_force(spark):
    """Cutoffs and verdicts over whole tables at sf0.01, worked out again in plain Python with exact fractions."""
    from fractions import Fraction

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, sf).collect()}
    hashed = {r.doc_id: r.u for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)).alias("u")).collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    def statistics(t):
        n, chars, symbols, dup, repeat = base_measures(t)
        lines = sum(bool(words(x)) for x in t.split("\n"))
        n = max(n, 1)
        return {"symbols": symbols / n, "repeats": repeat / n, "dup_lines": dup / max(lines, 1), "capitals": sum(c.isupper() and __import__("unicodedata").category(c) == "Lu" for c in t) / max(chars, 1), "marks": (t.count("!") + t.count("?")) / n, "long_words": chars / n}

    stats = {i: statistics(t) for i, t in texts.items()}
    failed = {i: base_measures(t)[0] < 50 or 100 * base_measures(t)[4] > 50 * base_measures(t)[0] for i, t in texts.items()}
    rules = list(quality_rules.RULES)
    first = {i: tuple(next((k for k, c in enumerate(quality_rules.RULES[r][1]) if s[r] >= c), len(quality_rules.RULES[r][1])) for r in rules) for i, s in stats.items()}
    held = [i for i in label if label[i] in (0, 1) and not failed[i]]
    stratum = lambda i: "short" if len(words(texts[i])) < 200 else "middle" if len(words(texts[i])) < 1000 else "long"
    good = Counter(stratum(i) for i in held if label[i])
    assert sum(good.values()) * (1 - quality_rules.PATH_SHARE) > quality_rules.least_good(strata=1)
    cutoffs = 0
    groups = quality_rules.merged(good, quality_rules.RISK, quality_rules.ERROR)
    for group in groups:
        own = [i for i in held if stratum(i) in group]
        shape = Counter((bool(label[i]), first[i]) for i in own if not label[i] or hashed[i] < quality_rules.PATH_SHARE)
        chain = quality_rules.path(sorted((g, f, n) for (g, f), n in shape.items()))
        test = [i for i in own if label[i] and hashed[i] >= quality_rules.PATH_SHARE]
        at = None
        for step in chain:
            k, n, p = sum(any(f <= s for f, s in zip(first[i], step) if s >= 0) for i in test), len(test), Fraction(2, 100)
            tail = sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(k + 1))
            if tail > Fraction(5, 100) / len(groups):
                break
            at = step
        cutoffs += at is not None
        for i in texts:
            if stratum(i) in group:
                reject = at is not None and any(f <= s for f, s in zip(first[i], at) if s >= 0)
                assert got[i].kept == (not failed[i] and not reject), i
    assert cutoffs and any(not r.kept and not r.base_failed for r in got.values())


def test_rules_use_every_label(spark, monkeypatch):
    """Beyond thousands of labels, too, each one counts: rare kinds of junk get their cutoffs, and cutoffs are those of a chain over all labelled rows."""
    r = random.Random(4)
    u = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)).alias("u")
    hashed = {x.doc_id: x.u for x in spark.range(19000).select(F.col("id").alias("doc_id")).select("doc_id", u).collect()}
    # bad rows: nearly all have symbols; ten, which no sample by hash would have, have marks or capitals instead
    rare = sorted(range(13000, 19000), key=hashed.get)[-10:]
    rows = [(i, True, 0, int(r.random() < 0.01) * r.randint(1, 20), int(r.random() < 0.01) * r.randint(1, 30)) for i in range(13000)]
    rows += [(i, False, r.randint(10, 100), 0, 0) for i in range(13000, 19000) if i not in rare]
    rows += [(i, False, 0, 31 + k, 0) if k % 2 else (i, False, 0, 0, 41 + k) for k, i in enumerate(rare)]
    m = spark.createDataFrame([(i, 100, s, 0, k, c) for i, _, s, k, c in rows], "doc_id bigint, n_words bigint, n_symbols bigint, n_dup_lines bigint, n_marks bigint, n_capitals bigint")
    m = m.selectExpr("*", "0L as n_repeat_words", "10L as n_lines", "500L as word_chars")
    labels = spark.createDataFrame([(i, int(good)) for i, good, *_ in rows], "doc_id bigint, quality int")
    cut = quality_rules.thresholds(m, labels)
    rules = list(quality_rules.RULES)

    def first(s, k, c):
        stats = {"symbols": s / 100, "marks": k / 100, "capitals": c / 500, "long_words": 5.0}
        return tuple(next((j for j, x in enumerate(quality_rules.RULES[q][1]) if stats.get(q, 0) >= x), len(quality_rules.RULES[q][1])) for q in rules)

    of = {i: first(*x) for i, _, *x in rows}
    shape = Counter((good, of[i]) for i, good, *_ in rows if not good or hashed[i] < quality_rules.PATH_SHARE)
    assert sum(n for (good, _), n in shape.items() if not good) == 6000
    test = [of[i] for i, good, *_ in rows if good and hashed[i] >= quality_rules.PATH_SHARE]
    at = None
    for step in quality_rules.path(sorted((g, f, n) for (g, f), n in shape.items())):
        k, n, term, tail = sum(any(f <= j for f, j in zip(x, step)) for x in test), len(test), math.log(0.98) * len(test), 0.0
        for x in range(k + 1):
            tail += math.exp(term)
            term += math.log((n - x) / (x + 1) * 0.02 / 0.98)
        if tail > 0.05:  # labels are of short texts only, so all strata are tested as one
            break
        at = step
    want = {q: quality_rules.RULES[q][1][j] for q, j in zip(rules, at) if j >= 0}
    assert cut == {s: want for s in quality_rules.NAMES} and {"symbols", "marks", "capitals"} <= set(want)
    monkeypatch.setattr(quality_rules, "DRIVER_ROWS", 0)  # the way for more rows than the driver takes
    assert quality_rules.thresholds(m, labels) == cut


# --- 6 near-duplicates --------------------------------------------------------------------------------------------


def shingle_set(t):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {p for h in holders.values() for p in itertools.combinations(h, 2)}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if 100 * len(x & y) >= 85 * len(x | y):
            u, v = find(i), find(j)
            parent[max(u, v)] = min(u, v)
    return {i: (len(s), find(i)) for i, s in sets}


def check_components(got, rows):
    want = brute_components(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id), r
            assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id]))


def test_near_duplicates_brute_force(spark, docs, texts):
    check_components(neardup.near_duplicates(docs).collect(), list(texts.items()))


def test_near_duplicate_families(spark):
    """Copies, chains of small edits, boilerplate shared by unlike texts, short texts and ties."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    boiler = [r.choice(vocabulary) for _ in range(60)]
    for family in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 40, 200, 700]))]
        for _ in range(12):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            if family % 5 == 0:
                t = boiler + t
            rows.append((k, " ".join(t).upper() if r.random() < 0.2 else " ".join(t)))
            k += 1
    chain = [f"c{i}" for i in range(150)]
    for step in range(20):
        rows.append((k, " ".join([f"x{j}" for j in range(step)] + chain[step:])))
        k += 1
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_components(neardup.near_duplicates(d).collect(), rows)


def test_near_duplicate_family_near_the_threshold(spark):
    """Families whose members change an absent text by a few words each, by exchange, loss and gain, so that about half of their pairs link."""
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []
    for length, most in ((120, 3), (400, 5)):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(160):
            t = list(base)
            for _ in range(r.randint(1, most)):
                at = r.randrange(len(t))
                t[at : at + r.choice([1, 1, 0, 2])] = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 1, 2]))]
            rows.append((len(rows), " ".join(t[r.choice([0, 0, 0, 12]) :])))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_components(neardup.near_duplicates(d).collect(), rows)


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Every key of more than three rows is dealt over several tasks: copies, lists, heads and labels alike; the result stays that of brute force."""
    r = random.Random(21)
    base = [f"h{r.randrange(900)}" for _ in range(90)]
    rows = [(i, " ".join(base)) for i in range(12)] + [(100 + i, None) for i in range(8)]
    for i in range(40):
        t = list(base)
        for _ in range(r.randint(1, 3)):
            t[r.randrange(len(t))] = f"n{r.randrange(9000)}"
        rows.append((20 + i, " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for m in (common, neardup):
        monkeypatch.setattr(m, "HOT_ROWS", 3)
    check_components(neardup.near_duplicates(d).collect(), rows)
    left = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(9, 9)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (5, "c")], "k int, w string")
    hot = common.hot_keys(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"])
    assert hot.count() == 3
    for how in ("inner", "left"):
        assert sorted(map(tuple, common.spread_join(left, right, ["k"], how, hot).collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


def test_near_duplicate_ids_repeated_with_other_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [("3", one), ("5", one), ("5", two), ("9", two), ("7", "c d e"), ("7", "f g h")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = neardup.near_duplicates(d).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [("3", "3", True), ("5", "3", False), ("5", "3", False), ("7", "7", True), ("7", "7", True), ("9", "3", False)]
    assert sorted(map(tuple, neardup.drop_near_duplicates(d).collect())) == [("3", one), ("7", "c d e")]


def test_near_duplicate_edges(odd, empty):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[None].component_id is None and by[None].kept and by[1].n_shingles == 0 and by[2].component_id == 2 and by[4].n_shingles == 1
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[5] == 1


# --- 7 secrets ----------------------------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def test_secrets_base(spark, sf, texts):
    for r in queries.op7_secret_scan(spark, sf).collect():
        spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(texts[r.doc_id] or "") if ok(m)]
        told = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]
        n = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n[0], n[1], n[2]) and r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(","))


def test_secrets_assignments():
    spans = lambda t: [(t[a:b]) for a, _, b in secrets.scan_text(t)[1]]
    assert spans('db = "Zx9$kQ!72mLp"\ndb_password = db') == ["Zx9$kQ!72mLp"]
    assert spans("<clientSecret>q8#Lw!z0Vn2r</clientSecret>") == ["q8#Lw!z0Vn2r"]
    assert spans("colour = 'Zx9$kQ!72mLp'") == [] and spans('password = "${PASSWORD}"') == [] and spans("the password: a word about tokens") == []
    assert secrets.redact_text("token=abcdefghijkl12 ok") == "[secret] ok" and secrets.redact_text(None) is None


V, W = "Zx9$kQ!72mLp", "q8#Lw!z0Vn2r"
#: A text and the literals that are found in it.
ASSIGNED = [
    (f'db = "{V}"\ndb_password = db', [V]), (f'db_password = db\ndb = "{V}"', [V]), (f'x = "{V}"\ny = x\nz = y\nauth_token = z', [V]), ("a = b\nb = a\npassword = a", []),
    (f'x = "{V}"\nx = "plain"\npassword = x', []), (f"<clientSecret>{W}</clientSecret>", [W]), (f"colour = '{V}'", []), ('password = "${PASSWORD}"', []), ("the password: a word about tokens", []),
    (r'password = "ab\"cD9$xQ!72"', [r'ab\"cD9$xQ!72']), ("password = \"it's9$kQ!72mLp\"", ["it's9$kQ!72mLp"]), (f'secret = """{V}"""', [V]), (f'secret = """{V}\nqQ7!zz"""', [V + "\nqQ7!zz"]),
    ('password = "Zx9$kQ" + "!72mLp"', ["Zx9$kQ", "!72mLp"]), ('password = "Zx9$kQ" \\\n  "!72mLp"', ["Zx9$kQ", "!72mLp"]), ('password = ("Zx9$kQ"\n  "!72mLp")', ["Zx9$kQ", "!72mLp"]),
    ('a = "Zx9$kQ"\nb = "!72mLp"\npassword = a + b', ["Zx9$kQ", "!72mLp"]), ('$p = "Zx9$kQ" . "!72mLp"; $password = $p;', ["Zx9$kQ", "!72mLp"]), (f"DB_PASSWORD=${{DB_PASS:-{V}}}", [V]),
    (f'connect(host, password="{V}")', [V]), (f'client.setPassword("{V}")', [V]), (f'props.setProperty("db.password", "{V}")', [V]), (f'<add key="apiSecret" value="{V}"/>', [V]),
    (f'<string name="api_secret">{V}</string>', [V]), (f'<user name="bob" password="{V}"/>', [V]), (f'passwords:\n  - {V}\n  - "{W}"\nother: 1', [V, W]), (f'password: str = "{V}"', [V]),
    (f'let key: &str = "x"; let api_key: Option<&str> = "{V}";', [V]), (f'var password string = "{V}"', [V]), (f'private static final String PASSWORD = "{V}";', [V]), (f'char secret[] = "{V}";', [V]),
    (f'# db = "{V}"\ndb_password = db', []), (f'# password = "{V}"', [V]), (f'/* secret: "{V}" */', [V]), (f'<!-- token="{V}" -->', [V]), (f'os.environ["SECRET_KEY"] = "{V}"', [V]),
    (f'password = os.getenv("DB_PASSWORD", "{V}")', [V]), ('password = os.getenv("DB_PASSWORD_NAME9")', []), (f'password = cfg.get("pw") or "{V}"', [V]), (f'const token = process.env.TOKEN || "{V}";', [V]),
    (f'{{"client_secret": "{V}", "x": 1}}', [V]), (f'"tokens": ["{V}", "{W}"]', [V, W]), (f"$password = '{V}';", [V]), (f"'password' => '{V}',", [V]), ('secretkey = "wJalrXUtnFEMI/K7MDENG"', ["wJalrXUtnFEMI/K7MDENG"]),
    (f'contraseña = "{V}"', [V]), ('tokenizer = "sentencepiece-bpe-32k"', []), ('token_url = "https://example.com/oauth/token"', []), (f'password = "https://u:{V}@h/x"', [f"https://u:{V}@h/x"]),
    ("export AUTH_TOKEN=Zx9kQ72mLpRt", ["Zx9kQ72mLpRt"]), (f'password := "{V}"', [V]), (f'password = f"{V}"', [V]), ("I don't know the secret = it isn't here", []), (f'key = "{V}"', []), (f'private_key = "{V}"', [V]),
    ("token: Zx9kQ72mLpRt # comment", ["Zx9kQ72mLpRt"]), (f'password="{V}" # see "other"', [V]), (f'url = "http://x//y"; secret = "{V}"', [V]), ('password = ""\n', []),
]


@pytest.mark.parametrize("text,want", ASSIGNED, ids=[t[:30] for t, _ in ASSIGNED])
def test_secrets_lexer(text, want):
    found = [text[a:b] for a, _, b in secrets.scan_text(text)[1]]
    assert all(any(w in f for f in found) for w in want) and (want or not found), found
    left = secrets.redact_text(text)
    assert all(w not in left for w in want)


def test_secrets_lexer_is_linear():
    """Openings without an end, long chains and many assignments take time in proportion to the text."""
    import time

    for x in ('"', "<a ", "/*", '"""', "<!--", "key=[ ", "key=a+", 'a\\"', " # a", "secret ${", 'password = "Zx9kQ72mLpw!"\n'):
        took = []
        for n in (4000, 16000):
            began = time.perf_counter()
            secrets.scan_text(x * n + " password")
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5, (x, took)


def test_secrets_edges(odd, empty):
    out = secrets.scan_secrets(odd, keep=["doc_id"]).collect()
    assert len(out) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    assert secrets.scan_secrets(empty).count() == 0
    red = secrets.redact_secrets(odd)
    assert red.columns == odd.columns and red.count() == len(ODD)


# --- 8 WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip_payloads(spark):
    big = "é<p>" * 40_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "short"), (6, "u", "short"), (7, "u", "line\r\n\r\nWARC/1.1\r\n" * 20), (2, "http://again", big), (None, "n", big)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), payloads=True).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    want = Counter((i, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == want
    assert Counter(r.url for r in got) == Counter(u.translate({10: None, 13: None}) if u else None for _, u, _ in rows)
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == 1 and r.page_id == 2
        else:
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and r.refers_to is None


def test_warc_segments_and_chunks():
    assert warc.dechunk(b"4\r\nabcd\r\n2;x=y\r\nef\r\n0\r\n\r\n") == b"abcdef"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.reassemble([(2, b"b"), (1, b"a")], 2) == b"ab"
    assert warc.reassemble([(1, b"a"), (3, b"c")], 2) is None and warc.reassemble([(1, b"a"), (2, b"b")], 3) is None and warc.reassemble([(1, b"a")], None) is None


def test_warc_clashing_columns(spark):
    """Other columns, whatever their names, are ignored; ids of other types are read as numbers."""
    d = spark.createDataFrame([(1, "a" * 200, "x"), (2, "a" * 200, "y"), (None, None, None)], "page_id int, html string, rows string")
    for c in ("payload_digest", "payload_bytes", "first", "url", "d", "p"):
        d = d.withColumn(c, F.lit("clash"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.url) for r in warc.round_trip(d).collect()), key=str)
    assert got == [(1, "response", None, "clash"), (2, "revisit", 1, "clash"), (None, "response", None, "clash")]


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- 9 licenses ---------------------------------------------------------------------------------------------------


def test_license_base(spark, sf, texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in queries.op9_license_scan(spark, sf).collect():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        own = pattern.findall(t)
        places, labels = [], set()
        for phrase, label in license.PHRASES.items():
            parts = phrase.split()
            for i in range(len(own) - len(parts) + 1):
                if own[i : i + len(parts)] == parts:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_join_is_exact():
    """The prefix, length and positional filters lose nothing that comparing all sets finds."""
    r = random.Random(8)
    vocabulary = [f"t{i}" for i in range(40)]
    templates = [(f"l{i}", " ".join(r.sample(vocabulary, r.randint(1, 14)))) for i in range(40)]
    join = license.Join(templates, {w.encode(): r.randint(0, 90) for w in vocabulary}, 0.8)
    for _ in range(1500):
        block = [w.encode() for w in r.choices(vocabulary, k=r.randint(0, 30))]
        want = {}
        for k, (_, t) in enumerate(templates):
            own = set(license.words(t))
            if (c := len(own & set(block)) / len(own)) >= 0.8:
                want[k] = c
        assert dict(join.block(block)) == pytest.approx(want)


def test_license_blocks_brute_force():
    """Every template with a window of SPREAD words for each of its own that holds enough of its tokens is met, with the best containment; and no other is."""
    r = random.Random(12)
    vocabulary = [f"t{i}" for i in range(30)]
    templates = [(f"l{i}", " ".join(r.sample(vocabulary, r.randint(1, 9)))) for i in range(25)]
    join = license.Join(templates, {w.encode(): r.randint(0, 90) for w in vocabulary}, 0.8)
    for _ in range(600):
        tokens = [r.choice([*vocabulary, *["other"] * 40]).encode() for _ in range(r.randint(0, 60))]
        want = {}
        for k, (_, t) in enumerate(templates):
            own, size = set(license.words(t)), license.SPREAD * len(license.words(t))
            best = max((len(own & set(tokens[i : i + size])) for i in range(max(1, len(tokens)))), default=0) / len(own)
            if best >= 0.8:
                want[k] = best
        got = {}
        for t, a, b, s, _ in join.blocks(tokens):
            own = set(license.words(templates[t][1]))
            assert s == len(own & set(tokens[a:b])) / len(own) and b - a <= license.SPREAD * len(license.words(templates[t][1]))
            got[t] = max(s, got.get(t, 0))
        assert got == pytest.approx(want)


def test_license_full_containment_over_lines_and_two_statements(spark):
    rows = [
        (1, "Released under\nthe MIT License", "mit", 1.0), (2, "all of us had rights to it, which the others, so it was told, had reserved", "", 0.0),
        (3, "All rights reserved. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl,reserved", 1.0),
    ]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id bigint, text string")
    for r in license.scan_licenses(d).collect():
        _, _, labels, score = rows[r.doc_id - 1]
        assert (r.labels, r.score) == (labels, score), r


def test_license_edges(odd, empty, spark):
    out = license.scan_licenses(odd).collect()
    assert len(out) == len(ODD) and all(r.labels == "" and r.score == 0.0 for r in out)
    assert license.scan_licenses(empty).count() == 0
    d = spark.createDataFrame([(1, "x\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation\ny")], "doc_id bigint, text string")
    r = license.scan_licenses(d).first()
    assert r.labels == "gpl" and r.base_labels == "gpl"


def test_license_wrapped_at_any_width(spark):
    """Statements in the usual wrapping of license files, in comments, and wrapped at every width down to a word a line; scattered words are none."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    rows = [("mit", mit), ("mit", "\n *\n".join(f" * {x}" for x in mit.split("\n")))]
    rows += [(label, "Some words before.\n" + textwrap.fill(text, width, break_long_words=False) + "\nand after it") for label, text in license.TEMPLATES for width in (1, 20, 40, 60, 80)]
    rows += [("", "\n".join(f"{w} and then a line of other words" for w in license.TEMPLATES[3][1].split()))]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    for r in license.scan_licenses(d).collect():
        assert set(filter(None, [rows[r.doc_id][0]])) <= set(filter(None, r.labels.split(","))) and (rows[r.doc_id][0] or not r.labels), (rows[r.doc_id], r)


# --- 10 quality ---------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in queries.op10_quality_score(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.8
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_brute_force(spark, sf, texts):
    """The whole query against sizes compressed here, under a calibration that is fitted here; and labels that are held out teach it nothing."""
    import zstandard as zs

    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality in (0, 1)")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good, bad, (bias, slope) = quality_clf.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    pair = [zs.ZstdCompressor(level=quality_clf.LEVEL, dict_data=zs.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def difference(t):
        b = (t or "").encode()
        g, x = (sum(len(c.compress(b[a : a + quality_clf.PART])) for a in range(0, max(1, len(b)), quality_clf.PART)) for c in pair)
        return (x - g) / (x + g)

    got = {r.doc_id: r for r in queries.op10_quality_score(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(bias + slope * quality_clf.SCALE * difference(t)))), abs=1e-9), i
    assert slope > 0  # the better a text fits the good dictionary, the likelier it is good
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_clf.fit(docs, wrong.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)) == (good, bad, [bias, slope])


def test_quality_learns_from_whole_texts(spark):
    """What is bad only in its later part teaches the dictionary of bad text."""
    r = random.Random(6)
    clean, junk = ([w + "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)] for w in ("", "z"))

    def of(vocabulary, n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    rows = [(i, of(clean, 2200) if i % 2 else of(clean, 1200) + " " + of(junk, 1000)) for i in range(120)]
    assert all(len(t.split(" z")[0]) > 6000 for _, t in rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    good, bad, _ = quality_clf.fit(d, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int"))
    shared = [sum(f" {w} ".encode() in x for w in junk) for x in (good, bad)]
    assert shared[0] == 0 and shared[1] > 100


def test_quality_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_clf.score_quality(odd, quality_clf.fit(odd, none)).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (4, None), (None, 0)], "doc_id bigint, quality int")
    out = quality_clf.score_quality(odd, quality_clf.fit(odd, one))
    assert out.count() == len(ODD) and all(0 <= r.score <= 1 for r in out.collect())
    assert quality_clf.score_quality(empty, (b"", b"", [])).count() == 0
