"""Streams over append-only logs: windows with watermarks, TTL, rate limits and upserting sinks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def append_log(df: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Rows added to a Parquet log that is partitioned by day, so that time-range scans skip other days."""
    df.withColumn("day", F.date_format(ts_col, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def scan_log(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, ts_col: str = "ts") -> DataFrame:
    """Rows with start <= ts < end; whole days outside are not read."""
    df = spark.read.parquet(path)
    if start:
        df = df.where((F.col("day") >= F.lit(start[:10])) & (F.col(ts_col) >= F.lit(start).cast("timestamp_ntz")))
    if end:
        df = df.where((F.col("day") <= F.lit(end[:10])) & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz")))
    return df.drop("day")


def stream_log(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def tumbling(df: DataFrame, ts_col: str, width: str, keys: list[str], aggregates: dict[str, Column], watermark: str | None = None) -> DataFrame:
    """Aggregates by window and keys; batch or stream alike. A stream needs a watermark to drop late rows and old state."""
    if watermark:  # watermarks are on zoned stamps
        df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return df.groupBy(F.window(ts_col, width).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, *aggregates)


def alive(df: DataFrame, ts_col: str, ttl_seconds: int, now: Column) -> DataFrame:
    """Rows that have not outlived their time: created at or after now - ttl. A NULL stamp never expires."""
    return df.where(F.col(ts_col).isNull() | (F.col(ts_col) >= now - F.make_dt_interval(secs=F.lit(ttl_seconds))))


def recent_counts(df: DataFrame, key: str, ts_col: str, seconds: int) -> DataFrame:
    """df with n_recent: how many rows of the key lie in the last so many seconds up to each row, itself included."""
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("n_recent", F.count(F.lit(1)).over(w))


def allowed(times_ms: list[int], limit: int, window_ms: int, recent: deque | None = None) -> list[bool]:
    """Which of a key's events, in order of time, a sliding-window limiter lets through; denied ones do not count, and a stamp of exactly a window ago still does."""
    recent = deque() if recent is None else recent
    out = []
    for t in times_ms:
        while recent and recent[0] < t - window_ms:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def rate_limit(df: DataFrame, key: str, ts_col: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """id, key, ts and allowed of every event, in order of (ts, id) within its key.

    The limiter's state is sequential in each key. Rows of a key come to their task sorted and stream through it in Arrow batches: state is a queue of at most
    limit stamps, so a hot key is one long task but never one large block of memory.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, {ts_col} timestamp_ntz, allowed boolean"
    rows = df.select(id_col, key, F.col(ts_col).cast("timestamp_ntz").alias(ts_col)).repartition(key).sortWithinPartitions(key, ts_col, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = object(), deque()
        for b in batches:
            flags: list[bool] = []
            ms = b[ts_col].astype("datetime64[us]").astype("int64") // 1000
            for k, t in zip(b[key].tolist(), ms.tolist(), strict=True):
                if k != last:
                    last, recent = k, deque()
                flags += allowed([t], limit, seconds * 1000, recent)
            yield b.assign(allowed=flags)

    return rows.mapInPandas(run, schema)


def rate_limit_stream(df: DataFrame, key: str, ts_col: str, id_col: str, limit: int, seconds: int) -> DataFrame:
    """The same limiter over a stream: a key's state is its last allowed stamps, which go when the watermark has passed the window."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values([ts_col, id_col])
        ms = (rows[ts_col].astype("datetime64[us]").astype("int64") // 1000).tolist()
        flags = allowed(ms, limit, seconds * 1000, recent)
        state.update((list(recent),))
        state.setTimeoutTimestamp(max(ms[-1] + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({id_col: rows[id_col].to_numpy(), key: rows[key].to_numpy(), "allowed": flags})

    df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, f"{seconds} seconds")
    return df.groupBy(key).applyInPandasWithState(run, f"{id_col} {kind}, {key} {df.schema[key].dataType.simpleString()}, allowed boolean", "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append", timeout: int = 600) -> None:
    """Runs a stream over all that is there, into a Parquet path or a function of micro-batches, and ends."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the stream did not end in {timeout} s")
