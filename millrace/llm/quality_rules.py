"""Quality rules with risk-controlled thresholds, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, written

SYMBOLS = "#*$%&|<>"
#: Share of good documents that all rules together may reject in a stratum, and the chance that this is exceeded anywhere.
RISK, ERROR = 0.02, 0.05
#: This share of a stratum's labelled good documents, and all of its bad ones, shape the chain of cutoffs; all other good ones test it.
PATH_SHARE = 0.2
#: Up to so many different rows of steps (see thresholds) are counted on the driver, more by Spark.
DRIVER_ROWS = 50_000

#: Rule: (statistic over the measures below, cutoffs from lax to strict). Rows at or above a cutoff are rejected.
GRID = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [8.0, 4.0, 3.0, 2.5, 2.0, 1.5, *GRID]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", GRID),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", GRID),
    "capitals": ("n_capitals / greatest(word_chars, 1)", GRID),
    "marks": ("n_marks / greatest(n_words, 1)", [8.0, 4.0, 3.0, 2.0, 1.5, 1.0, *GRID]),
    "long_words": ("word_chars / greatest(n_words, 1)", [200.0, 100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
}
NAMES = ("short", "middle", "long")
#: Strata of length. Where labels are few, neighbours are tested as one (see merged).
STRATA = "CASE WHEN n_words < 200 THEN 'short' WHEN n_words < 1000 THEN 'middle' ELSE 'long' END"


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measures(text: Column) -> list[Column]:
    """Columns that count in a whole text. A null text counts as an empty one."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return [
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        F.regexp_extract_all(t, F.lit(f"({WORD})")).alias("words"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        _count_of(t, "!?").alias("n_marks"),
    ]


def repeated_words(h: str, n: str = "n_words") -> Column:
    """How many words stand in 3-word windows that occur twice or more. h: 64-bit hashes of the windows, in order.

    A window's hash and place share one long: the place in as many low bits as the text's length needs, the hash's upper bits above. Sorted
    (primitive longs, no comparisons of objects), equal windows lie side by side; neighbours whose full hashes agree are repeats. Places of
    repeats, sorted again, cover three words each, less what they overlap the one before: least(3, distance). n log n for any text.
    """
    return F.expr(f"""
        CASE WHEN {n} < 4 OR size({h}) = size(array_distinct({h})) THEN 0L ELSE
          aggregate(
            sort_array(flatten(transform(
              array(sort_array(transform({h}, (x, i) -> ((shiftright(x, bits) << bits) | i)))),
              s -> filter(transform(s, (x, i) ->
                CASE WHEN (i > 0 AND element_at({h}, CAST((x & mask) + 1 AS INT)) = element_at({h}, CAST((s[i - 1] & mask) + 1 AS INT)))
                       OR (i < size(s) - 1 AND element_at({h}, CAST((x & mask) + 1 AS INT)) = element_at({h}, CAST((s[i + 1] & mask) + 1 AS INT)))
                     THEN x & mask ELSE -1L END), p -> p >= 0)))),
            named_struct('last', -3L, 'n', 0L),
            (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)),
            a -> a.n) END""")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with n_words and every count of measures, over whole texts. Nothing is exploded or shuffled."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *measures(F.col(f"`{text_col}`")))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("h", F.expr("CASE WHEN n_words >= 4 THEN transform(sequence(0, CAST(n_words AS INT) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array(0L) END"))
    d = d.withColumn("bits", F.ceil(F.log2(F.greatest(F.col("n_words"), F.lit(2)).cast("double") + 1)).cast("int")).withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words("h").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_marks")


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly in logarithms: the p-value of "the rejection rate is over p" when k of n are rejected."""
    return F.expr(f"""
        aggregate(sequence(0L, CAST({k} AS BIGINT)),
          named_struct('term', {n} * ln(1 - {p}D), 'sum', CAST(0 AS DOUBLE)),
          (a, i) -> named_struct('term', a.term + ln(greatest(CAST({n} - i AS DOUBLE), 1e-300)) - ln(i + 1D) + ln({p}D / (1 - {p}D)), 'sum', a.sum + exp(a.term)),
          a -> a.sum)""")


Counts = list[tuple[list[int], list[int]]]


def _no_counts() -> Counts:
    return [([0] * len(grid), [0] * len(grid)) for _, grid in RULES.values()]


def chain(counts: Callable[[tuple[int, ...]], Counts]) -> list[tuple[int, ...]]:
    """Sets of cutoffs, each at least as strict as the one before: for each rule its step in the grid, -1 while it is off.

    counts: of the documents that a set does not reject, how many good and how many bad ones each rule rejects from each step on. A set is made from the last
    by the one change that rejects the fewest more good rows, of these the most more bad ones, of these with the laxest step. When no
    change rejects more bad rows, the rules in use become stricter by turns for as long as no more good rows go.
    """
    rules = list(RULES)
    at, out = (-1,) * len(rules), []
    while True:
        best, left = None, counts(at)
        for r, (good, bad) in enumerate(left):
            g = b = 0
            for j in range(len(good)):
                g, b = g + good[j], b + bad[j]
                if j > at[r] and b and (best is None or (g, -b, j) < best[0]):
                    best = (g, -b, j), r
        if best is None:
            break
        (_, _, j), r = best
        at = (*at[:r], j, *at[r + 1 :])
        out.append(at)
    open_ = [r for r in range(len(rules)) if at[r] >= 0]
    while open_:
        for r in list(open_):
            j = at[r] + 1
            if j == len(RULES[rules[r]][1]) or any(left[r][0][: j + 1]):
                open_.remove(r)
                continue
            at = (*at[:r], j, *at[r + 1 :])
            out.append(at)
    return out


def path(rows: list[tuple[bool, tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """The chain for rows on the driver: whether good, each rule's first step that rejects (the grid's length if none does), how many such documents."""
    left = list(rows)  # rows that are not rejected yet

    def counts(at: tuple[int, ...]) -> Counts:
        left[:] = [x for x in left if not any(f <= j for f, j in zip(x[1], at, strict=True))]
        out = _no_counts()
        for ok, first, n in left:
            for r, f in enumerate(first):
                if f < len(out[r][0]):
                    out[r][0 if ok else 1][f] += n
        return out

    return chain(counts)


def _rejected(at: tuple[int, ...]) -> str:
    return " or ".join(f"f_{i} <= {j}" for i, j in enumerate(at) if j >= 0) or "false"


def wide_path(rows: DataFrame) -> list[tuple[int, ...]]:
    """The chain for rows (good, f_0, f_1, ..., n) that are too many for the driver: one aggregation for each set, which gives a count for each step."""
    firsts = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"f_{i}").alias("step")) for i in range(len(RULES))]))

    def counts(at: tuple[int, ...]) -> Counts:
        out = _no_counts()
        left = rows.where(f"not ({_rejected(at)})").select("good", "n", firsts.alias("first"))
        for x in left.groupBy("good", "first.rule", "first.step").agg(F.sum("n").alias("n")).collect():
            if x.step < len(out[x.rule][0]):
                out[x.rule][0 if x.good else 1][x.step] = x.n
        return out

    return chain(counts)


def merged(good: dict[str, int], risk: float, error: float) -> list[tuple[str, ...]]:
    """The strata in groups of neighbours that are tested as one. good: labelled good documents of each stratum.

    As long as a group has too few of them to be tested for any cutoff, the smallest joins its smaller neighbour; what is then left to share the error is fewer
    groups. Only counts of labels decide, before any document is rejected, so the tests stay valid.
    """
    groups: list[tuple[str, ...]] = [(s,) for s in NAMES]
    size = lambda g: sum(good.get(s, 0) for s in g)
    while len(groups) > 1:
        k = min(range(len(groups)), key=lambda i: size(groups[i]))
        if size(groups[k]) * (1 - PATH_SHARE) >= least_good(risk, error, len(groups)) * 1.1:
            break
        j = min((i for i in (k - 1, k + 1) if 0 <= i < len(groups)), key=lambda i: size(groups[i]))
        groups[min(j, k) : max(j, k) + 1] = [(*groups[min(j, k)], *groups[max(j, k)])]
    return groups


def thresholds(m: DataFrame, labels: DataFrame, *, label_col: str = "quality", label_id: str = "doc_id", risk: float = RISK, error: float = ERROR) -> dict[str, dict[str, float]]:
    """stratum: rule: cutoff, the strictest set of cutoffs of each stratum whose false rejections are proven to be few.

    The rules are tested together, by split fixed-sequence testing: each stratum has one chain of sets of cutoffs, lax to strict (see chain), made from all bad
    documents and PATH_SHARE of the good ones. All other good documents test it: of n of them k are rejected by any rule of a set, and
    P(Binomial(n, risk) <= k) must not exceed error / strata. Testing stops at the first set that fails, so a chain costs one test's error. With
    probability 1 - error every stratum loses at most risk of its good documents to all rules together. A stratum whose first test fails, as it
    must with fewer than least_good(risk, error, strata) good documents to test, has no cutoffs, so it rejects nothing; to spare that, strata with few labels are
    tested as one with a neighbour (see merged), and then have its cutoffs. Every labelled document that passes the base rules has its part, none is left
    out: a good one shapes or tests, as no proof holds on documents that shaped what it proves. What shapes the chains is counted by each rule's first step
    that rejects; up to DRIVER_ROWS such counts go to the driver, else Spark counts anew for each set. What tests them is one aggregation with a sum for each set.
    """
    rules = list(RULES)
    known = labels.select(F.col(f"`{label_id}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.max("label") == 1).alias("good"))
    firsts = [F.array_position(F.array(*[F.expr(RULES[r][0]) >= c for c in RULES[r][1]]), True) - 1 for r in rules]
    firsts = [F.when(f < 0, len(RULES[r][1])).otherwise(f).cast("int").alias(f"f_{i}") for i, (r, f) in enumerate(zip(rules, firsts, strict=True))]
    held = m.join(known, "doc_id").where(~_base_failed())
    held = written(held.select(F.expr(STRATA).alias("stratum"), "good", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)).alias("u"), *firsts), "labelled")
    n = {r.stratum: r.n for r in held.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return {}
    groups = merged(n, risk, error)
    of = {s: "+".join(g) for g in groups for s in g}
    names = ["+".join(g) for g in groups]
    held = held.withColumn("stratum", F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("stratum")))
    steps = [f"f_{i}" for i in range(len(rules))]
    shapes = ~F.col("good") | (F.col("u") < PATH_SHARE)
    seen = written(held.where(shapes).groupBy("stratum", "good", *steps).agg(F.count(F.lit(1)).alias("n")), "steps")
    if seen.count() > DRIVER_ROWS:
        paths = {s: wide_path(seen.where(F.col("stratum") == s)) for s in names}
    else:
        rows = sorted(seen.collect())
        paths = {s: path([(r.good, tuple(r[f] for f in steps), r.n) for r in rows if r.stratum == s]) for s in names}
    if not any(paths.values()):
        return {}

    sums = [F.struct(F.lit(s).alias("stratum"), F.lit(k).alias("step"), F.sum(F.expr(f"CASE WHEN stratum = '{s}' THEN 1L ELSE 0L END")).alias("n"), F.sum(F.expr(f"CASE WHEN stratum = '{s}' AND ({_rejected(at)}) THEN 1L ELSE 0L END")).alias("k")) for s in names for k, at in enumerate(paths[s])]
    t = held.where(~shapes).agg(F.array(*sums).alias("t")).select(F.explode("t").alias("t")).select("t.*")
    passed = (F.col("n") > 0) & F.when(F.col("k") > F.col("n") * risk, F.lit(False)).otherwise(binomial_tail("k", "n", risk) <= error / len(names))
    ok = {(r.stratum, r.step): r.ok for r in t.select("stratum", "step", passed.alias("ok")).collect()}
    out = {}
    for s in NAMES:
        own = paths[of[s]]
        last = next((k for k in range(len(own)) if not ok[of[s], k]), len(own)) - 1
        if last >= 0:
            out[s] = {r: RULES[r][1][j] for r, j in zip(rules, own[last], strict=True) if j >= 0}
    return out


def least_good(risk: float = RISK, error: float = ERROR, strata: int = len(NAMES)) -> int:
    """How many tested good documents a stratum needs for any cutoff, if none of them is rejected. About 1 / (1 - PATH_SHARE) times as many labels."""
    return math.ceil(math.log(error / strata) / math.log(1 - risk))


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the rules that reject (failed_rules) of every whole text.

    kept is false if the base rules fail, or if any rule's statistic is at or above its cutoff (see thresholds) in the document's stratum of
    length. A null or empty text has no words, so it fails the base rules. A null id has no label but is judged like others; ids that repeat are
    judged by row; a document with several labels counts once if one of them is 1. Without labels there are no cutoffs and the base rules decide. An
    empty table gives no rows. Other columns, whatever their names, are ignored.

    Texts are read once; their counts are written to the shared folder, as cutoffs need them all before the first verdict. The
    cutoffs, a few numbers whatever the input, stand in the plan.
    """
    m = written(measured(docs, id_col=id_col, text_col=text_col), "measures")
    cut = thresholds(m, labels, label_col=label_col, risk=risk, error=error)
    failed = [F.when(F.expr(f"({STRATA}) = '{s}' AND {RULES[r][0]} >= {c}D"), F.lit(r)) for r in RULES for s in NAMES if (c := cut.get(s, {}).get(r)) is not None]
    out = m.withColumn("base_failed", _base_failed()).withColumn("failed_rules", F.array_join(F.array_compact(F.array(*failed)), ",") if failed else F.lit(""))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ((~F.col("base_failed")) & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
