"""Benchmark decontamination by template windows with slot consistency."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import flat_map_batches, free_name, map_batches, written

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[$€£¥%°]")
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset("$ € £ ¥ % ° mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees meter meters metre metres kilometer kilometers mph kmh".split())
WINDOW, THRESHOLD, LITERALS = 5, 0.8, 3
#: Template windows that go to the workers at once; a larger benchmark is scanned for in blocks of about so many.
BLOCK_WINDOWS = 2_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_NUM, _UNIT, _NAME = 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


_SLOT = {k: np.uint64(_word_hash(f"<{k}>")) for k in (_NUM, _UNIT, _NAME)}


class _Words(dict):
    """Tokens to row numbers of what is known of each token."""

    def __init__(self):
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.fresh: list[tuple[int, int]] = []  # hash and kind of the tokens that are not in the arrays yet

    def __missing__(self, token: str) -> int:
        low = token.lower()
        self[token] = i = len(self)
        self.fresh.append((_word_hash(low), _NUM if token[0].isdigit() or low in NUMBERS else _UNIT if low in UNITS else _NAME if token[0].isupper() else 0))
        return i

    def canonical(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and slot kind of each token, names kept as words and names as slots. first: where a text begins."""
        if self.fresh:
            h, kind = zip(*self.fresh, strict=True)
            self.hashes, self.kinds, self.fresh = np.concatenate([self.hashes, np.array(h, np.uint64)]), np.concatenate([self.kinds, np.array(kind, np.int8)]), []
        h, kind = self.hashes[ids], self.kinds[ids]
        number = kind == _NUM
        beside = np.zeros(len(ids), bool)  # a unit is one only beside a number
        if len(ids) > 1:
            beside[1:] |= number[:-1] & ~first[1:]
            beside[:-1] |= number[1:] & ~first[1:]
        plain = np.where(number, _NUM, np.where((kind == _UNIT) & beside, _UNIT, 0)).astype(np.int8)
        named = np.where((plain == 0) & (kind == _NAME), _NAME, plain).astype(np.int8)
        slots = np.array([0, *(_SLOT[k] for k in (_NUM, _UNIT, _NAME))], np.uint64)
        return np.where(plain > 0, slots[plain], h), plain, np.where(named > 0, slots[named], h), named


def _windows(h: np.ndarray, kind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window and whether it has literal words enough."""
    n = len(h) - length + 1
    out, lit = np.zeros(n, np.uint64), np.zeros(n, np.int16)
    for i in range(length):
        out = out * _K + h[i : i + n]
        lit += kind[i : i + n] == 0
    return _mix(out ^ np.uint64(length)), lit >= min(LITERALS, length)


def _first_length(kind: np.ndarray, least: int) -> int | None:
    """The shortest windows, from least on, of which one has literals enough; None if not even the whole item has."""
    literal = np.concatenate([[0], (kind == 0).cumsum()])
    for n in range(least, len(kind) + 1):
        if (literal[n:] - literal[:-n]).max() >= min(LITERALS, n):
            return n
    return None


class _Index:
    """The template windows of a block of benchmark items.

    An item's windows have WINDOW tokens, or so many more that one of them has literals enough. Those that have are counted; those that have them with names as
    slots, too, are looked up in both readings. An item all of whose windows lack them then is looked up by longer windows in addition.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.tokens: dict[int, list[str]] = {}
        self.canonical: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # hashes of the tokens, names as words and as slots
        self.length: dict[int, int] = {}
        self.starts: dict[int, list[int]] = {}
        self.renamed: dict[int, set[int]] = {}  # windows with literals enough when names are slots
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # hash: item, start
        lengths = set()
        words = _Words()
        for k, (_, text) in enumerate(items):
            tokens = TOKEN.findall(text or "")
            if len(tokens) < LITERALS:
                continue
            ids = np.fromiter((words[t] for t in tokens), np.int64, len(tokens))
            first = np.zeros(len(ids), bool)
            first[0] = True
            ph, pk, nh, nk = words.canonical(ids, first)
            shortest = min(WINDOW, len(tokens))
            length = _first_length(pk, shortest)
            if length is None:
                continue
            longer = _first_length(nk, length)
            for n, readings in {length: ((ph, pk), (nh, nk)), longer: ((nh, nk),)}.items() if longer != length else ((length, ((ph, pk), (nh, nk))),):
                if n is None:
                    continue
                for h, kind in readings:
                    w, ok = _windows(h, kind, n)
                    for i in np.nonzero(ok)[0].tolist():
                        if (k, i) not in self.at[int(w[i])]:
                            self.at[int(w[i])].append((k, i))
                lengths.add(n)
            self.tokens[k], self.canonical[k], self.length[k] = tokens, (ph, nh), length
            self.starts[k] = np.nonzero(_windows(ph, pk, length)[1])[0].tolist()
            self.renamed[k] = set(np.nonzero(_windows(nh, nk, length)[1])[0].tolist())
        self.lengths = sorted(lengths)
        self.sorted = np.array(sorted(self.at), np.uint64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def __bool__(self) -> bool:
        return bool(self.at)


def _consistent(index: _Index, places: set[tuple[int, int]], tokens: list[str], ph: np.ndarray, nh: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """The items (by their number in the block) of which a text has enough windows. places: item, distance of the text's tokens from the item's; ph, nh: the text's hashes in both readings.

    At a place every counted window is compared, also one with too few literals to be looked up. Within a place every slot value of the item stands
    for one value of the text, and several may stand for the same; a window that says otherwise does not count.
    """
    found: dict[int, set[int]] = defaultdict(set)
    changed: dict[int, int] = defaultdict(int)
    for k, shift in sorted(places):
        item, length, to = index.tokens[k], index.length[k], {}
        a, b = max(0, shift), min(len(tokens), shift + len(item))
        ip, iname = index.canonical[k]
        plain, named = np.zeros(len(item), bool), np.zeros(len(item), bool)
        plain[a - shift : b - shift] = ip[a - shift : b - shift] == ph[a:b]
        named[a - shift : b - shift] = iname[a - shift : b - shift] == nh[a:b]
        same, either = (np.concatenate([[0], x.cumsum()]) for x in (plain, plain | named))
        windows = [(i, same[i + length] - same[i] < length) for i in index.starts[k] if either[i + length] - either[i] == length]
        for i, v in sorted(windows, key=lambda w: (w[1] and w[0] not in index.renamed[k], w[0])):  # windows that are looked up come first
            fresh: dict[str, str] = {}
            for x, y in zip(item[i : i + length], tokens[i + shift : i + shift + length], strict=True):
                p, q = x.lower(), y.lower()
                if (p != q or p[0].isdigit() or p in NUMBERS or (v and x[0].isupper())) and fresh.setdefault(p, q) != q:
                    break
            else:
                if all(to.get(p, q) == q for p, q in fresh.items()):
                    to |= fresh
                    found[k].add(i)
        changed[k] = max(changed[k], sum(p != q for p, q in to.items()))
    out = []
    for k, s in found.items():
        n, total = len(s), len(index.starts[k])
        if 2 * len(index.renamed[k]) >= total >= 2 * LITERALS:  # a text that changes names may differ in what stands between them
            n, total = max((n, total), (len(s & index.renamed[k]), len(index.renamed[k])), key=lambda x: x[0] / x[1])
        if n >= THRESHOLD * total:
            out.append((k, n, total, n / total, changed[k]))
    return out


def _scanner(index: _Index):
    """texts -> for each the list of what _consistent gives."""
    words = _Words()

    def scan(texts: list[str | None]) -> list[list[tuple]]:
        nonlocal words
        if len(words) > 250_000:
            words = _Words()
        out: list[list[tuple]] = [[] for _ in texts]
        step: list[int] = []
        size = 0
        for k, t in enumerate([*texts, None]):  # some MB at once, whole texts
            if k == len(texts) or size > 1_000_000:
                if step:
                    block([texts[i] for i in step], step, out)
                step, size = [], 0
            if k < len(texts) and t:
                step.append(k)
                size += len(t)
        return out

    def block(texts, at, out):
        tokens = [TOKEN.findall(t) for t in texts]
        lens = np.array([len(x) for x in tokens], np.int64)
        ends = lens.cumsum()
        total = int(ends[-1])
        if not total:
            return
        ids = np.fromiter(map(words.__getitem__, chain.from_iterable(tokens)), np.int64, total)
        first = np.zeros(total + 1, bool)
        first[ends - lens] = True
        first = first[:total]
        doc = np.repeat(np.arange(len(texts)), lens)
        ph, pk, nh, nk = words.canonical(ids, first)
        hits: dict[int, set] = defaultdict(set)
        for length in index.lengths:
            if total < length:
                continue
            inside = doc[length - 1 :] == doc[: total - length + 1]
            for h, kind in ((ph, pk), (nh, nk)):
                w, ok = _windows(h, kind, length)
                near = np.nonzero(index.gate[(w >> np.uint64(44)).astype(np.int64)] & ok & inside)[0]
                near = near[np.isin(w[near], index.sorted)]
                for p in near.tolist():
                    d = int(doc[p])
                    start = p - int(ends[d] - lens[d])
                    hits[d].update((k, start - i) for k, i in index.at[int(w[p])])
        for d, found in hits.items():
            a, b = int(ends[d] - lens[d]), int(ends[d])
            out[at[d]] = _consistent(index, found, tokens[d], ph[a:b], nh[a:b])

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in blocks, each of which is small enough for a broadcast, with whether it is the only one. A block leaves driver and workers when the next is asked for."""
    b = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    size = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (BLOCK_WINDOWS * 4)))
    sc = benchmark.sparkSession.sparkContext
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        shared = sc.broadcast((uuid.uuid4().hex, [(r.id, r.text) for r in rows]))
        yield shared, n == 1
        if n > 1:
            shared.destroy()


_SCANNERS: dict[str, Callable] = {}


def _scanner_of(shared) -> Callable:
    """A worker's scanner of a block, which stays known from task to task."""
    if (key := shared.value[0]) not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = _scanner(_Index(shared.value[1]))
    return _SCANNERS[key]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item whose text it holds, word for word or with other numbers, names and units.

    Texts become tokens (numbers, runs of letters, unit signs), lower-cased. Numbers and units beside a number become typed
    placeholders; capitalised words do in one of two readings (in the other they are words, as at a sentence's start). Windows of five tokens
    with three literal ones at least are joined by hash; where one is met, all of the item's windows are compared in place, each token in either
    reading. Every slot value of the item must stand for one value of the text (see _consistent). A document holds an item if 0.8 of the
    item's windows are found so, or 0.8 of those that have three literals even with all names as placeholders (half of all at least). An item without
    three literals in any five tokens has longer windows, up to the whole; an item of three or four tokens is one window; a shorter one, or one
    without three literals, matches nothing. Null and empty texts match nothing; repeated rows give repeated results; an empty table
    on either side gives no rows. Other columns are ignored.

    Benchmark windows are joined in blocks of bounded size against all rows, without a shuffle; of more than one block each one's result is written before the
    next is read. Ids may have any type. Returns doc_id, item_id, matched_windows, item_windows, coverage, changed_slots.
    """
    item = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("matched_windows", T.LongType()), T.StructField("item_windows", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("changed_slots", T.LongType())])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for shared, only in _blocks(benchmark, item_col, item_text_col):

        def make(shared=shared):
            scan = _scanner_of(shared)

            def run(texts):
                hits = [(i, *hit) for i, found in enumerate(scan(texts)) for hit in sorted(found)]
                return list(zip(*hits, strict=True)) if hits else [[]] * (len(schema) + 1)

            return run

        part = flat_map_batches(rows, make, schema, ["text"], ["doc_id"])
        ids = docs.sparkSession.createDataFrame(list(enumerate(i for i, _ in shared.value[1])), T.StructType([T.StructField("at", T.LongType()), T.StructField("item_id", item)]))
        part = part.join(F.broadcast(ids), "at").select("doc_id", "item_id", "matched_windows", "item_windows", "coverage", "changed_slots")  # a block's items
        part = part if only else written(part, "contamination")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows that find_contamination reports; all columns stay as they are. Rows with null or empty texts stay, repeated rows go or stay together, and an
    empty table on either side drops nothing."""
    flag = free_name("hit", docs.columns)
    for shared, only in _blocks(benchmark, item_col, item_text_col):

        def make(shared=shared):
            scan = _scanner_of(shared)
            return lambda texts: [[bool(x) for x in scan(texts)]]

        docs = map_batches(docs, make, [T.StructField(flag, T.BooleanType())], [text_col]).where(f"not {flag}").drop(flag)
        docs = docs if only else written(docs, "uncontaminated")
    return docs
