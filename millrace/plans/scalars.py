"""Scalar functions: strings, conditionals, mathematics, dates, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import json as J
from millrace.functions.dialect import call, dequantize_int8, install, quantize_int8, type_of
from millrace.plans.registry import query, table


def _q(name: str, source: str, key: str, sql: str, **columns):
    """A query of one table's key and some expressions, given as functions that make them."""

    @query(name, f"SELECT {key}, {sql} FROM {source}")
    def run(spark, d):
        install(spark)
        return table(spark, d, source).select(key, *[c().alias(n) for n, c in columns.items()])

    return run


C, L = F.col, F.lit

_q("FS1_length", "part", "p_partkey", "CAST(length(p_name) AS INT) AS a", a=lambda: F.length("p_name"))
_q("FS2_case", "part", "p_partkey", "upper(p_name) AS a, lower(p_brand) AS b", a=lambda: F.upper("p_name"), b=lambda: F.lower("p_brand"))
_q(
    "FS3_substring", "part", "p_partkey", "substr(p_name, 3) AS a, substr(p_name, 1, 4) AS b, substr(p_name, 1, 2) AS c, substr(p_name, 500, 3) AS e",
    a=lambda: call("substr", "p_name", 3), b=lambda: call("substr", "p_name", 1, 4), c=lambda: call("substr", "p_name", 0, 2), e=lambda: call("substr", "p_name", 500, 3),
)
_q("FS4_concat", "part", "p_partkey", "p_brand || '-' || nullif(p_type, 'PROMO') AS a", a=lambda: F.concat("p_brand", L("-"), F.nullif("p_type", L("PROMO"))))
_q(
    "FS5_trim", "part", "p_partkey", "trim('  ' || p_name || ' ') AS a, ltrim('xyx' || p_name, 'xy') AS b, rtrim(p_name || '..', '.') AS c",
    a=lambda: call("trim", F.concat(L("  "), C("p_name"), L(" "))), b=lambda: call("ltrim", F.concat(L("xyx"), C("p_name")), L("xy")), c=lambda: call("rtrim", F.concat(C("p_name"), L("..")), L(".")),
)
_q("FS6_instr", "part", "p_partkey", "CAST(instr(p_name, 'a') AS INT) AS a, CAST(instr(p_brand, '#') AS INT) AS b", a=lambda: call("instr", "p_name", L("a")), b=lambda: call("position", "p_brand", L("#")))
_q(
    "FS7_split_part", "part", "p_partkey", "split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', 2) AS b, split_part(p_brand, '#', 9) AS c, '' AS e",
    a=lambda: call("split_part", "p_brand", L("#"), 1), b=lambda: call("split_part", "p_brand", L("#"), 2), c=lambda: call("split_part", "p_brand", L("#"), 9), e=lambda: call("split_part", "p_brand", L("#"), 0),
)
_q("FS8_replace", "part", "p_partkey", "replace(p_brand, 'Brand', 'B') AS a", a=lambda: F.replace("p_brand", L("Brand"), L("B")))
_q("FC1_coalesce", "part", "p_partkey", "coalesce(nullif(p_size, 5), -1) AS a", a=lambda: F.coalesce(F.nullif("p_size", L(5)), L(-1)))
_q("FC2_ifnull", "part", "p_partkey", "ifnull(nullif(p_brand, 'Brand#11'), 'none') AS a", a=lambda: F.ifnull(F.nullif("p_brand", L("Brand#11")), L("none")))
_q("FC3_nullif", "part", "p_partkey", "nullif(p_size, 9) AS a", a=lambda: F.nullif("p_size", L(9)))
_q("FC4_if", "part", "p_partkey", "CASE WHEN nullif(p_size, 9) > 20 THEN 'big' ELSE 'small' END AS a", a=lambda: F.expr("if(nullif(p_size, 9) > 20, 'big', 'small')"))


@query("FC5_typeof", "SELECT event_id, 'int64' AS a, CASE WHEN value > 50 THEN 'null' ELSE 'float64' END AS b, 'varchar' AS c, 'timestamp' AS e FROM events")
def fc5(spark, d):
    t = table(spark, d, "events").withColumn("v", F.when(C("value") <= 50, C("value")))
    return t.select("event_id", type_of(t, "user_id").alias("a"), type_of(t, "v").alias("b"), type_of(t, "props").alias("c"), type_of(t, "ts").alias("e"))


_q("FM1_abs", "customer", "c_custkey", "abs(c_acctbal) AS a", a=lambda: F.abs("c_acctbal"))
_q("FM2_round", "customer", "c_custkey", "round(c_acctbal) AS a, round(c_acctbal / 8, 1) AS b", a=lambda: F.round("c_acctbal"), b=lambda: F.round(C("c_acctbal") / 8, 1))
_q("FM3_ceil", "customer", "c_custkey", "CAST(ceil(c_acctbal) AS BIGINT) AS a", a=lambda: F.ceil("c_acctbal"))
_q("FM4_floor", "customer", "c_custkey", "CAST(floor(c_acctbal) AS BIGINT) AS a", a=lambda: F.floor("c_acctbal"))
_q("FM5_trunc", "customer", "c_custkey", "trunc(c_acctbal) AS a", a=lambda: call("truncate", "c_acctbal"))
_q("FM6_power", "part", "p_partkey", "pow(p_size, 2) AS a", a=lambda: F.pow(C("p_size").cast("double"), L(2.0)))
_q("FM7_sqrt", "part", "p_partkey", "round(sqrt(p_retailprice), 9) AS a", a=lambda: F.round(F.sqrt("p_retailprice"), 9))
_q("FM8_ln", "part", "p_partkey", "round(ln(p_retailprice), 9) AS a", a=lambda: F.round(F.ln("p_retailprice"), 9))
_q("FM9_log10", "part", "p_partkey", "round(log10(p_retailprice), 9) AS a", a=lambda: F.round(call("log", "p_retailprice"), 9))
_q("FM10_log2", "part", "p_partkey", "round(log2(p_retailprice), 9) AS a", a=lambda: F.round(F.log2("p_retailprice"), 9))
_q(
    "FM11_mod", "part", "p_partkey", "(((p_size - 25) % 7) + 7) % 7 AS a, (((p_size - 25) % 7) + 7) % 7 AS b, CASE WHEN p_size = 4 THEN NULL ELSE (((p_size - 25) % abs(p_size - 4)) + abs(p_size - 4)) % abs(p_size - 4) END AS c",
    a=lambda: call("mod", C("p_size") - 25, 7), b=lambda: call("mod", C("p_size") - 25, -7), c=lambda: call("mod", C("p_size") - 25, C("p_size") - 4),
)


@query("FM12_random", "SELECT count(*) AS n, true AS inside FROM part")
def fm12(spark, d):
    return table(spark, d, "part").select(F.rand().alias("r")).agg(F.count(L(1)).alias("n"), F.min((C("r") >= 0) & (C("r") < 1)).alias("inside"))


@query("FD1_now", "SELECT count(*) AS n, true AS later FROM part")
def fd1(spark, d):
    return table(spark, d, "part").select(F.current_timestamp().alias("t")).agg(F.count(L(1)).alias("n"), F.min(C("t") > F.lit("2024-01-01").cast("timestamp")).alias("later"))


_q("FD2_date", "events", "event_id", "strftime(ts, '%Y-%m-%d') AS a", a=lambda: call("date", "ts"))
_q("FD3_time", "events", "event_id", "strftime(ts, '%H:%M:%S') AS a", a=lambda: call("time", "ts"))
_q("FD4_datetime", "events", "event_id", "strftime(ts, '%Y-%m-%d %H:%M:%S') AS a", a=lambda: call("datetime", "ts"))
_q("FD5_strftime", "events", "event_id", "strftime(ts, '%y/%m/%d %H.%M.%S %w %j %U 100%%') AS a", a=lambda: call("strftime", L("%y/%m/%d %H.%M.%S %w %j %U 100%%"), "ts"))
_q("FD6_strptime", "events", "event_id", "date_trunc('second', ts) AS a, CAST(NULL AS TIMESTAMP) AS b", a=lambda: call("strptime", L("%Y-%m-%d %H:%M:%S"), call("datetime", "ts")), b=lambda: call("strptime", L("%Y-%m-%d"), "event_type"))
_q(
    "FD7_date_add", "events", "event_id", "ts + INTERVAL 36 HOUR AS a, ts - INTERVAL 2 WEEK AS b, ts + INTERVAL 250 MILLISECOND AS c, ts AS e, ts + to_days(CAST(user_id AS INT)) AS f",
    a=lambda: call("date_add", "ts", 36, L("hours")), b=lambda: call("date_sub", "ts", 2, L("w")), c=lambda: call("date_add", "ts", 250, L("ms")), e=lambda: call("date_add", "ts", 3, L("fortnight")), f=lambda: call("date_add", "ts", "user_id", L("day")),
)
_q(
    "FD8_date_diff", "events", "event_id", "date_sub('day', TIMESTAMP '2024-01-15 12:00:00', ts) AS a, date_sub('hour', TIMESTAMP '2024-01-15 12:00:00', ts) AS b, date_sub('second', TIMESTAMP '2024-01-15 12:00:00', ts) AS c",
    **{n: (lambda u=u: call("date_diff", "ts", L("2024-01-15 12:00:00").cast("timestamp_ntz"), L(u))) for n, u in (("a", "day"), ("b", "hour"), ("c", "s"))},
)
_q("FD9_date_trunc", "events", "event_id", "CAST(date_trunc('month', ts) AS TIMESTAMP) AS a, CAST(date_trunc('week', ts) AS TIMESTAMP) AS b, date_trunc('hour', ts) AS c, date_trunc('minute', ts) AS e", **{n: (lambda u=u: call("date_trunc", L(u), "ts")) for n, u in (("a", "month"), ("b", "week"), ("c", "hour"), ("e", "minute"))})
_q("FJ1_json_extract", "events", "event_id", "CAST(json_extract(props, '$.k') AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b", a=lambda: call("json_extract", "props", L("$.k")), b=lambda: call("json_extract", L("{bad"), L("$.k")))
_q(
    "FJ2_json_contains", "events", "event_id", "CAST(json_extract(props, '$.k') AS BIGINT) = 3 AS a, true AS b, false AS c",
    a=lambda: J.json_contains(C("props"), "3", "$.k"), b=lambda: J.json_contains(L('{"tags":["ai","db"]}'), '"ai"', "$.tags"), c=lambda: J.json_contains(L('{"tags":["ai"]}'), '["ai","x"]', "$.tags"),
)
_q("FJ3_json_array_length", "events", "event_id", "3 AS a, 2 AS b, CAST(NULL AS INT) AS c", a=lambda: call("json_array_length", F.concat(L("[1,2,"), C("event_id"), L("]"))), b=lambda: call("json_array_length", L('{"x":[1,2]}'), L("$.x")), c=lambda: call("json_array_length", "props"))
_q("FJ4_json_object", "events", "event_id", """'{"id":' || event_id || ',"p":' || replace(props, ' ', '') || ',"t":"' || event_type || '"}' AS a""", a=lambda: J.json_object("t", C("event_type"), "id", C("event_id"), "p", C("props")))
_q("FJ5_json_array", "events", "event_id", """'[' || event_id || ',"' || event_type || '",null]' AS a""", a=lambda: J.json_array(C("event_id"), C("event_type"), F.lit(None).cast("string")))
_q(
    "FJ6_json_set", "events", "event_id", """replace(substr(props, 1, length(props) - 1), ' ', '') || ',"z":1}' AS a, '{"k":9}' AS b, replace(props, ' ', '') AS c""",
    a=lambda: J.json_set(C("props"), "$.z", "1"), b=lambda: J.json_set(C("props"), "$.k", "9"), c=lambda: J.json_insert(C("props"), "$.k", "9"),
)
_q("FJ7_json_replace", "events", "event_id", """'{"k":"new"}' AS a, replace(props, ' ', '') AS b""", a=lambda: J.json_replace(C("props"), "$.k", "new"), b=lambda: J.json_replace(C("props"), "$.none", "new"))
_q("FJ8_json_remove", "events", "event_id", "'{}' AS a, '[1,3]' AS b", a=lambda: J.json_remove(C("props"), "$.k"), b=lambda: J.json_remove(L("[1,2,3]"), "$[1]"))

_V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _vector(name: str, sql: str, expr, rounded: int = 6):
    @query(name, f"SELECT vec_id, round({sql}, {rounded}) AS x FROM embeddings")
    def run(spark, d):
        install(spark)
        e = table(spark, d, "embeddings")
        one = e.where("vec_id = 0").select(C("embedding").alias("q"))  # a single row
        return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(expr(), rounded).alias("x"))

    return run


_vector("FV1_l2", f"list_distance(CAST(embedding AS DOUBLE[]), {_V0})", lambda: call("vector_distance", "embedding", "q"))
_vector("FV2_cosine", f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0})", lambda: call("vector_cosine_similarity", "embedding", "q"))
_vector("FV3_norm", "sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))", lambda: call("vector_norm", "embedding"))


@query(
    "V06_int8",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, (list_max(v) - list_min(v)) / 254.0 AS scale, (list_max(v) + list_min(v)) / 2.0 AS shift FROM e),
    q AS (SELECT *, list_transform(v, lambda x: CAST(round((x - shift) / scale) AS BIGINT)) AS q FROM s)
    SELECT vec_id, round(CAST(CAST(scale AS FLOAT) AS DOUBLE), 7) AS scale, round(CAST(CAST(shift AS FLOAT) AS DOUBLE), 7) AS shift, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_min(q) AS BIGINT) AS lo, CAST(list_max(q) AS BIGINT) AS hi,
    list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - (q[i] * scale + shift)))) <= scale * 0.5001 + 1e-6 AS near FROM q""",
)
def v06(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", quantize_int8("embedding"))
    off = F.array_max(F.zip_with(C("embedding").cast("array<double>"), dequantize_int8("q"), lambda x, y: F.abs(x - y)))
    q = F.transform(C("q.q"), lambda x: x.cast("long"))
    return e.select(
        "vec_id", F.round(C("q.scale").cast("double"), 7).alias("scale"), F.round(C("q.offset").cast("double"), 7).alias("shift"), F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(q).alias("lo"), F.array_max(q).alias("hi"),
        (off <= C("q.scale") * 0.5001 + 1e-6).alias("near"),
    )
