"""Class-wise segmentation of texts and byte-pair merges under a given vocabulary."""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.batches import PART_BYTES, parts, prepare

#: The classes' characters. Classes are tried in this order, and what none takes is a symbol.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
PUNCTUATION = r"!-/:-@\[-`{-~\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FE10}-\x{FE1F}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF1F}\x{FF3B}-\x{FF3F}\x{FF5B}-\x{FF65}"
SPACE = r"\s\x{85}\p{Z}"
#: The identifier of a character that the vocabulary lacks.
UNKNOWN = 2**32 - 1
#: Characters of the segments whose identifiers a worker keeps.
MEMO_CHARS = 1_000_000

_CLASSES = {
    "cjk": f"[{CJK}]", "space": f"[{SPACE}]", "digit": "[0-9]", "letter": rf"[\p{{IsAlphabetic}}&&[^{CJK}]]", "punct": f"[{PUNCTUATION}&&[^{SPACE}]]",
    "symbol": rf"[^{CJK}{SPACE}0-9\p{{IsAlphabetic}}{PUNCTUATION}]",
}


def segments(text: Column | str) -> Column:
    """The runs of characters of one class, in order; joined they are the text. A NULL text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(text, F.lit("(" + "|".join(f"{c}+" for c in _CLASSES.values()) + ")")), F.array().cast("array<string>"))


def class_of(segment: Column) -> Column:
    """The class of a segment, by its first character."""
    first = F.substring(segment, 1, 1)
    out = F.lit("symbol")
    for name, c in reversed(list(_CLASSES.items())[:-1]):
        out = F.when(first.rlike(c), F.lit(name)).otherwise(out)
    return out


class Bpe:
    """Byte-pair merges of single segments, by rank.

    vocabulary: token to identifier; merges: pairs of tokens, most urgent first. A segment begins as its characters. As long as neighbours stand in
    merges, all occurrences of the pair of the least rank are joined, from the left. A merged token's parts are merged before it in any
    trained list, so this is the order of one pair at a time.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.vocabulary, self.ranks = vocabulary, {p: k for k, p in enumerate(merges)}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.held = 0  # characters of the segments in memo

    def pieces(self, segment: str) -> list[str]:
        parts = list(segment)
        while len(parts) > 1:
            rank, pair = min(((self.ranks.get(p, len(self.ranks)), p) for p in zip(parts, parts[1:])), key=lambda x: x[0])
            if rank == len(self.ranks):
                break
            out, k = [], 0
            while k < len(parts):
                both = k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair
                out.append(parts[k] + parts[k + 1] if both else parts[k])
                k += 2 if both else 1
            parts = out
        return parts

    def ids(self, segment: str) -> tuple[int, ...]:
        """The identifiers of a segment's pieces; those of short segments are kept, up to MEMO_CHARS characters of them."""
        if (known := self.memo.get(segment)) is None:
            known = tuple(self.vocabulary.get(p, UNKNOWN) for p in self.pieces(segment))
            if len(segment) <= 64:
                if self.held + len(segment) > MEMO_CHARS:
                    self.memo.clear()
                    self.held = 0
                self.memo[segment] = known
                self.held += len(segment)
        return known

    def encode(self, segments) -> list[int]:
        return [i for s in segments for i in self.ids(s)]


_BUILT: dict[str, Bpe] = {}


def encode(df: DataFrame, vocabulary: dict[str, int], merges: list[tuple[str, str]], *, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """df with the token identifiers of each whole text. Segments are built in the JVM; merges run in Arrow batches of bounded bytes, with as many of the words that were seen as MEMO_CHARS allows kept by each worker."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, merges))  # a vocabulary, which the caller holds in memory

    @F.arrow_udf("array<bigint>")
    def run(s: pa.Array) -> pa.Array:
        key, v, m = shared.value
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Bpe(v, m)
        done = [lists_of(part, _BUILT[key]) for part in parts(s, PART_BYTES // 4)]
        return pa.concat_arrays(done or [pa.array([], pa.list_(pa.int64()))])

    def lists_of(part: pa.Array, bpe: Bpe) -> pa.Array:
        values, ends = array("q"), [0]
        for x in part:
            for segment in x.as_py():
                values.extend(bpe.ids(segment))
            ends.append(len(values))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int64)) if len(values) else pa.array([], pa.int64()))

    prepare(spark)
    return df.withColumn(out, run(segments(F.col(f"`{text_col}`"))))
