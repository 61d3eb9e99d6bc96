"""What the training-data operators share: words, shared storage and the Arrow map over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.batches import parts, prepare, trimmed
from millrace.session import fresh_path, remove, scratch, written  # noqa: F401 - for the operators

#: A word, as Spark's and DuckDB's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that a join leaves to one task, and the keys with more that are made known to all tasks at most.
HOT_ROWS, HOT_KEYS = 50_000, 200_000

_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() parts at exactly the six ASCII white-space bytes, which no multi-byte character holds."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased and nothing else: bytes.lower() leaves bytes over 127 alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")) % mod


def free_name(name: str, columns: list[str]) -> str:
    """name, or the like of it that no column has (Spark takes names without regard to case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """keys and parts (among how many tasks a key's rows are to be dealt) of the keys with more than HOT_ROWS rows; None if there are none.

    They are at most rows / HOT_ROWS; if these were too many for a broadcast after all, none is so hot as to matter among them.
    """
    if (counts.agg(F.max(n)).first()[0] or 0) <= HOT_ROWS:
        return None
    hot = written(counts.where(F.col(n) > HOT_ROWS).select(*keys, F.ceil(F.col(n) / HOT_ROWS).cast("int").alias("parts")), "hot")
    return hot if 0 < hot.count() <= HOT_KEYS else None


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys, how) with the rows of hot keys (see hot_keys) dealt over several tasks by their hash; right's rows of these keys go to each."""
    if hot is None:
        return left.join(right, keys, how)
    known = F.broadcast(hot)  # HOT_KEYS rows at most
    names = [*left.columns, *(c for c in right.columns if c not in keys)]
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce(F.col("parts"), F.lit(1))).cast("int")
    a = left.join(known, keys, "left").withColumn("salt", salt).drop("parts")
    b = right.join(known, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return a.join(b, [*keys, "salt"], how).select(*names)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of longs as one Arrow column of lists, without a Python object for each number."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def map_batches(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], inputs: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns computed from whole rows on Python workers, one Arrow batch at a time.

    make() runs once a task and gives a function from the input columns' lists to one list for each of fields. The columns
    named in keep (all, if None) pass through as they are, so decisions need no join back to the rows. A name in fields must
    not be a column that is kept; callers pick names of their own.
    """
    names = df.columns if keep is None else keep
    schema = T.StructType([df.schema[n] for n in names] + fields)
    kinds = [_ARROW[f.dataType] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for part in parts(b):
                got = fn(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs))
                arrays = [part.column(part.schema.get_field_index(c)) for c in names] + [_array(x, k) for x, k in zip(got, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in fields)])

    prepare(df.sparkSession)
    needed = list(dict.fromkeys([*names, *inputs]))
    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(lambda batches: trimmed(run(batches)), schema)


def flat_map_batches(df: DataFrame, make: Callable[[], Callable], schema: T.StructType, inputs: list[str], keep: list[str] | None = None) -> DataFrame:
    """Like map_batches, but the function gives whole output columns of any number of rows. With keep it first gives the number, within its input, of the
    row that each output row comes from; that row's columns in keep, as they are, come before those of schema."""
    kinds = [_ARROW[f.dataType] for f in schema]
    names = keep or []
    full = T.StructType([*(df.schema[n] for n in names), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for part in parts(b):
                got = fn(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs))
                kept = []
                if keep is not None:
                    at, *got = got
                    kept = [part.column(part.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *(_array(x, k) for x, k in zip(got, kinds, strict=True))], names=[f.name for f in full])

    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, *inputs])]).mapInArrow(lambda batches: trimmed(run(batches)), full)
