"""Language identification by unigram pieces with all segmentations summed."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_batches
from millrace.llm.tokens import START, VOCABULARY, load_pieces

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]{1,40}")
#: Training documents of a language, in expectation: the bound on the sample that is fitted.
DOCS_PER_LANGUAGE = 400
#: Rounds of expectation maximisation, and words whose arcs are laid out at once.
ROUNDS, PART_WORDS = 2, 20_000
LONGEST = 16
MEMO = 300_000


def unit(word: str) -> str:
    """A run of letters as it is scored: what the pattern lets in besides letters (such as superscript digits) goes."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


_K, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(c: np.ndarray):
    """The 64-bit hash of the 1, 2, … LONGEST characters from each place on; what runs over the end is not given."""
    c = (c.astype(np.uint64) + np.uint64(1)) * _C
    c ^= c >> np.uint64(29)
    h = np.zeros(len(c), np.uint64)
    for length in range(1, LONGEST + 1):
        if length > len(c):
            return
        h = h[: len(c) - length + 1] * _K + c[length - 1 :]
        yield length, h ^ (h >> np.uint64(32))


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The vocabulary by hash, and the arcs that it spans over words."""

    def __init__(self, pieces: list[str]):
        of = {}
        for k, p in enumerate(dict.fromkeys(pieces)):
            if 0 < len(p) <= LONGEST:
                *_, (_, h) = _hashes(_chars(p))
                of[int(h[0])] = k + 1  # 0 is for a character that is no piece
        self.keys = np.array(sorted(of), np.uint64)
        self.ids = np.array([of[int(x)] for x in self.keys], np.int64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.size = len(pieces) + 1

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of every piece that fits anywhere, by end and word. Words are of 40 characters at most, and under a million."""
        if not words:
            return (np.zeros(0, np.int64),) * 4
        if len(words) >= 1 << 20 or self.size >= 1 << 20:
            raise ValueError("words and pieces are numbered with 20 bits")
        c = _chars(START + START.join(words))
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word = np.repeat(np.arange(len(words)), lens)
        at = np.arange(len(c)) - np.repeat(lens.cumsum() - lens, lens)
        left = np.repeat(lens, lens) - at
        out = []
        for length, h in _hashes(c):
            near = np.nonzero(self.gate[(h & np.uint64(0xFFFFF)).astype(np.int64)] & (left[: len(h)] >= length))[0]
            found = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
            hit = self.keys[found] == h[near]
            near, k = near[hit], self.ids[found[hit]]
            if length == 1:  # every character is an arc, though it be no piece
                k, near = np.bincount(near, k, len(c)).astype(np.int64), np.arange(len(c))
            out.append((at[near] + length) << 46 | word[near] << 26 | at[near] << 20 | k)
        a = np.sort(np.concatenate(out))
        return a >> 26 & 0xFFFFF, a >> 20 & 63, a >> 46, a & 0xFFFFF


def _steps(end: np.ndarray):
    cuts = np.searchsorted(end, np.arange(1, (int(end[-1]) if len(end) else 0) + 2))
    return [(j + 1, a, b) for j, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]


def forward(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """log of each word's probability in each language, summed over all its segmentations. p: piece by language."""
    w, i, end, k = pieces.arcs(words)
    lens = np.array([len(x) + 1 for x in words])
    alpha = np.zeros((len(words), int(lens.max(initial=1)) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j, a, b in _steps(end):
        ways = alpha[w[a:b], i[a:b]] * p[k[a:b]]
        at = np.nonzero(np.r_[True, w[a + 1 : b] != w[a : b - 1]])[0]
        alpha[w[a:b][at], j] = np.add.reduceat(ways, at)
    return np.log(np.maximum(alpha[np.arange(len(words)), lens], 1e-300))


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected piece counts of words (of one language) under p: one column."""
    w, i, end, k = pieces.arcs(words)
    lens = np.array([len(x) + 1 for x in words])
    width = int(lens.max(initial=1)) + 1
    alpha, beta = np.zeros((len(words), width)), np.zeros((len(words), width))
    alpha[:, 0] = 1
    steps = _steps(end)
    for j, a, b in steps:
        alpha[:, j] += np.bincount(w[a:b], alpha[w[a:b], i[a:b]] * p[k[a:b]], len(words))
    beta[np.arange(len(words)), lens] = 1
    for j, a, b in reversed(steps):
        np.add.at(beta, (w[a:b], i[a:b]), p[k[a:b]] * beta[w[a:b], j])
    total = np.maximum(alpha[np.arange(len(words)), lens], 1e-300)
    return np.bincount(k, alpha[w, i] * p[k] * beta[w, end] / total[w] * counts[w], pieces.size)


def _parts(words: list[str], counts: np.ndarray):
    for a in range(0, len(words), PART_WORDS):
        yield words[a : a + PART_WORDS], counts[a : a + PART_WORDS]


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", pieces: list[str] | None = None, vocabulary: str = VOCABULARY, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, list[str]]:
    """(languages, log-free probabilities piece by language, pieces), by expectation maximisation over all segmentations.

    Fitted on a bounded sample: of each language's rows those whose md5(id, text) is under docs_per_language / rows of the language. Only
    counts of distinct words of this sample come to the driver. Rows without a language or text teach nothing. Languages are in
    alphabetical order; no rows give no languages.
    """
    pieces = load_pieces(vocabulary) if pieces is None else pieces
    table = Pieces(pieces)
    t = train.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    rows = {r.lang: r.n for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(rows)
    if not langs:
        return [], np.zeros((table.size, 0)), pieces
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), "text").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_language / rows[lang]))])[F.col("lang")]
    words = t.where(u < share).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{1,40})"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "word").toPandas()
    p = np.zeros((table.size, len(langs)))
    for x, lang in enumerate(langs):
        own = words[words.lang == lang]
        texts, counts = own.word.tolist(), own.n.to_numpy(float)
        for part, n in _parts(texts, counts):
            w, i, end, k = table.arcs(part)
            p[:, x] += np.bincount(k, n[w] * (end - i), table.size)
        for r in range(rounds + 1):
            p[:, x] = (p[:, x] + 0.1) / (p[:, x] + 0.1).sum()
            if texts and r < rounds:
                p[:, x] = sum(expected(part, n, table, p[:, x]) for part, n in _parts(texts, counts))
    p[0] = p[0].min() / 10  # a character that is no piece says nothing
    return langs, p, pieces


class Scorer:
    """Languages of texts under a fitted model. Words that were seen are kept, up to a bound."""

    def __init__(self, langs: list[str], p: np.ndarray, pieces: list[str]):
        self.langs, self.p, self.pieces = langs, p, Pieces(pieces)
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((MEMO + 1, len(langs)), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        for a in range(0, len(fresh), PART_WORDS):
            part = fresh[a : a + PART_WORDS]
            units = [unit(x) for x in part]
            at = len(self.memo)
            self.rows[at : at + len(part)] = np.where(np.array([bool(u) for u in units])[:, None], forward(units, self.pieces, self.p), 0)
            self.memo.update(zip(part, range(at, at + len(part)), strict=True))

    def _sums(self, words: list[str]) -> np.ndarray:
        """Of any number of words, in blocks that the memory of words can hold."""
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), MEMO // 2):
            total += self._rows_of(words[a : a + MEMO // 2]).sum(0, dtype=float)
        return total

    def _rows_of(self, words: list[str]) -> np.ndarray:
        fresh = [x for x in dict.fromkeys(words) if x not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            self._learn(fresh)
        return self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out: tuple[list[str], list[float]] = ([], [])
        step: list[list[str]] = []
        size = 0
        for t in [*texts, ...]:
            if t is ... or size > MEMO // 3:
                self._block(step, out)
                step, size = [], 0
            if t is not ...:
                step.append(LETTERS.findall(t.lower()) if t else [])
                size += len(step[-1])
        return out

    def _block(self, parts: list[list[str]], out: tuple[list[str], list[float]]) -> None:
        long = [p for p in parts if len(p) > MEMO // 2]
        flat = [] if long else [x for p in parts for x in p]
        rows = self._rows_of(flat) if flat and self.langs else None
        at = 0
        for p in parts:
            if not self.langs or not p or not any(map(unit, p[:50])) and not any(map(unit, p)):
                out[0].append(UNKNOWN)
                out[1].append(0.0)
                at += len(p)
                continue
            s = self._sums(p) if long else rows[at : at + len(p)].sum(0, dtype=float)
            at += len(p)
            e = np.exp(s - s.max())
            best = int(s.argmax())
            out[0].append(self.langs[best])
            out[1].append(float(e[best] / e.sum()))


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, list[str]], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all, if None) with lang_pred and score: the likeliest language of each whole text and its posterior share.

    Texts are lower-cased; their words are runs of letters, of which each 40 are a word of its own; a word's probability in a language
    is the sum over all ways to cut it into pieces (the forward algorithm). Ties go to the first language in the alphabet. A
    null text, one without a letter, and any text under a model without languages get "und" and 0. Repeated rows stay; an empty
    table gives no rows; columns with the new names are replaced. The model has a fixed size and goes to the workers; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *model))

    def make():
        if (key := shared.value[0]) not in _SCORERS:  # a worker's words stay known from task to task
            _SCORERS.clear()
            _SCORERS[key] = Scorer(*shared.value[1:])
        return _SCORERS[key]

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    return map_batches(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], [text_col], names)


def held_out(id_col: str | Column = "doc_id") -> Column:
    from millrace.llm.common import crc_mod

    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
