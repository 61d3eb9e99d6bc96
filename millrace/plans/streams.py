"""Queries over logs: streams that run to the end of what is there, TTL, rate limits and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.session import fresh_path
from millrace.streaming import logs


def _events_stream(spark, d):
    return logs.stream_log(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema)


@query("R01_append_stream", "SELECT event_id, user_id, event_type, value FROM events")
def r01(spark, d):
    out, check = fresh_path(spark, "stream"), fresh_path(spark, "check")
    logs.run_available(_events_stream(spark, d).select("event_id", "user_id", "event_type", "value"), out, check)
    return spark.read.parquet(out)


_NOW = "TIMESTAMP '2024-01-30 00:00:00'"


@query("R02_ttl", f"SELECT event_id, ts FROM events WHERE ts >= {_NOW} - INTERVAL 10 DAY")
def r02(spark, d):
    return logs.alive(table(spark, d, "events").select("event_id", "ts"), "ts", 10 * 86400, F.lit("2024-01-30").cast("timestamp_ntz"))


@query(
    "R03_rate_limit",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, k, event_id, true AS allowed, [t] AS recent FROM e WHERE k = 1
      UNION ALL SELECT user_id, k, event_id, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END
      FROM (SELECT e.user_id, e.k, e.event_id, e.t, list_filter(r.recent, lambda x: x >= e.t - 21600000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
    SELECT event_id, user_id, allowed FROM r""",
)
def r03(spark, d):
    return logs.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 6 * 3600).select("event_id", "user_id", "allowed")


@query("R03_recent_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def r03c(spark, d):
    return logs.recent_counts(table(spark, d, "events"), "user_id", "ts", 86400).select("event_id", "n_recent")


@query("R04_micro_batches", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type")
def r04(spark, d):
    out, check = fresh_path(spark, "stream"), fresh_path(spark, "check")

    def sink(batch, batch_id):  # a folder for each batch, so that a batch which is run again replaces itself
        batch.select("event_type", "value").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    logs.run_available(_events_stream(spark, d), sink, check)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s"))


_WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL"


@query("R05_tumbling_batch", _WINDOWS)
def r05(spark, d):
    return logs.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "s": F.round(F.sum("value"), 4)})


@query("R05_tumbling_stream", _WINDOWS)
def r05s(spark, d):
    stream = logs.tumbling(_events_stream(spark, d), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "s": F.sum("value")}, watermark="1 hour")
    out, check = fresh_path(spark, "stream"), fresh_path(spark, "check")
    logs.run_available(stream, lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"), check, mode="update")
    rows = spark.read.parquet(out)  # the last state of each window counts
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "s"), "batch").alias("x"))
    return last.select("window_start", "event_type", "x.n", F.round("x.s", 4).alias("s"))


@query("R05_log_range", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'")
def r05r(spark, d):
    path = fresh_path(spark, "log")
    logs.append_log(table(spark, d, "events").select("event_id", "ts", "value"), path)
    return logs.scan_log(spark, path, "2024-01-05 06:00:00", "2024-01-09 00:00:00")
