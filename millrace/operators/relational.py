"""Relational helpers that Spark has no single call for: GROUPS frames, table statistics, clustered writes, three-valued helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_groups(df: DataFrame, partition: list[str], order: list[Column | str], start: int, end: int, **aggregates: Column) -> DataFrame:
    """df with aggregates over a GROUPS frame: so many groups of peers before and after the current one.

    Peers are numbered by dense_rank; a RANGE frame over these numbers is the GROUPS frame. Both windows share one sort by partition and order.
    """
    peer = "__millrace_peer"
    numbered = df.withColumn(peer, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy(peer).rangeBetween(start, end)
    return numbered.select(*df.columns, *[a.over(w).alias(n) for n, a in aggregates.items()])


def in_null_safe(x: Column, values: list) -> Column:
    """x IN (values) in two values: NULL is equal to NULL and the result is never NULL."""
    out = F.lit(False)
    for v in values:
        out = out | x.eqNullSafe(F.lit(v))
    return out


def analyze(df: DataFrame, columns: list[str] | None = None, buckets: int = 10) -> DataFrame:
    """A row for each column: name, n_rows, n_nulls, n_distinct, min_value, max_value (as text) and an equi-width histogram of numeric columns.

    Two passes whatever the number of columns: one aggregate for counts and bounds, one for the histograms' buckets. Distinct counts are exact;
    all of them in one aggregate would expand each row once a column, so they are counted from (column, value) pairs that combine before the shuffle.
    """
    columns = df.columns if columns is None else columns
    numeric = [c for c in columns if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    col = {c: F.col(f"`{c}`") for c in columns}
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(col[c]).alias(f"c{i}") for i, c in enumerate(columns)],
        *[F.min(col[c]).cast("string").alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.max(col[c]).cast("string").alias(f"h{i}") for i, c in enumerate(columns)],
    ).first()
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col[c].cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")).select("p.i", "p.v").where("v is not null")
    ndv = pairs.groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"))
    spans = {i: (float(one[f"l{i}"]), float(one[f"h{i}"])) for i, c in enumerate(columns) if c in numeric and one[f"l{i}"] is not None}
    spark = df.sparkSession
    if spans:
        bucket = {i: F.least(F.lit(buckets - 1), F.floor((col[columns[i]].cast("double") - lo) / (((hi - lo) or 1.0) / buckets))).cast("int") for i, (lo, hi) in spans.items()}
        b = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("b")) for i, x in bucket.items()])).alias("p")).select("p.i", "p.b").where("b is not null").groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))
        hist = b.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0))).alias("histogram"))
    else:
        hist = spark.createDataFrame([], "i int, histogram array<bigint>")
    base = spark.createDataFrame([(i, c, one["n"], one["n"] - one[f"c{i}"], one[f"l{i}"], one[f"h{i}"]) for i, c in enumerate(columns)], "i int, column_name string, n_rows bigint, n_nulls bigint, min_value string, max_value string")
    return base.join(ndv, "i", "left").join(hist, "i", "left").select("column_name", "n_rows", "n_nulls", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min_value", "max_value", "histogram")


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int | None = None, bloom: list[str] | None = None, codec: str = "zstd") -> None:
    """Parquet with rows of near keys side by side: range-partitioned and sorted, so that row-group statistics let filters skip; bloom filters for equality."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    w = ranged.sortWithinPartitions(*keys).write.option("compression", codec)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.mode("overwrite").parquet(path)
