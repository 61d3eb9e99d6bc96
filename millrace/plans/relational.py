"""Relational queries: scans, predicates, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.dialect import call, install, sum_double
from millrace.operators.relational import analyze, over_groups, write_clustered
from millrace.plans.registry import query, table
from millrace.session import fresh_path



def rows():
    return F.count(F.lit(1))


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- scans and sources ------------------------------------------------------------------------------------------------


@query("S01_scan_project", "SELECT l_orderkey, l_quantity FROM lineitem")
def s01(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("S02_filter_range", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05 AND l_shipdate >= TIMESTAMP '1998-01-01'")
def s02(spark, d):
    return table(spark, d, "lineitem").where((F.col("l_quantity") < 10) & (F.col("l_discount") >= 0.05) & (F.col("l_shipdate") >= ts("1998-01-01"))).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("S03_equality_miss", "SELECT count(*) AS n FROM orders WHERE o_orderkey = -1")
def s03(spark, d):
    path = fresh_path(spark, "bloom")
    write_clustered(table(spark, d, "orders"), path, ["o_orderdate"], bloom=["o_orderkey"])  # keys lie scattered, so only the bloom filters can skip
    return spark.read.parquet(path).where("o_orderkey = -1").agg(rows().alias("n"))


@query("S04_primary_key_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def s04(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("S05_covering_equality", "SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey = 5")
def s05(spark, d):
    return table(spark, d, "orders").where("o_custkey = 5").select("o_custkey", "o_totalprice")


@query("S06_index_equality", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def s06(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")


@query("S07_two_sided_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000 AND 100 < o_orderkey")
def s07(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1000 and o_totalprice <= 50000 and 100 < o_orderkey").select("o_orderkey", "o_totalprice")


@query("S08_count_star", "SELECT count(*) AS n FROM lineitem")
def s08(spark, d):
    return table(spark, d, "lineitem").agg(rows().alias("n"))


@query("S09_derived_table", "SELECT s, count(*) AS n FROM (SELECT o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_totalprice > 1000) a WHERE p < 200000 GROUP BY s")
def s09(spark, d):
    a = table(spark, d, "orders").where("o_totalprice > 1000").select(F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return a.where("p < 200000").groupBy("s").agg(rows().alias("n"))


@query("S10_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT b.o_custkey, count(*) AS n FROM big b JOIN big c ON b.o_custkey = c.o_custkey GROUP BY b.o_custkey")
def s10(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_s10")
    return spark.sql("WITH big AS (SELECT o_custkey, o_totalprice FROM millrace_s10 WHERE o_totalprice > 100000) SELECT b.o_custkey, count(*) AS n FROM big b JOIN big c ON b.o_custkey = c.o_custkey GROUP BY b.o_custkey")


# --- projections and predicates -----------------------------------------------------------------------------------------


@query("P01_project", "SELECT p_partkey, p_retailprice * 2 + 1 AS x, upper(p_brand) AS brand FROM part")
def p01(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 2 + 1).alias("x"), F.upper("p_brand").alias("brand"))


@query("P03_compare", "SELECT p_partkey, p_size = 5 AS eq, p_size <> 5 AS ne, p_size < 5 AS lt, p_size <= 5 AS le, p_size > 5 AS gt, p_size >= 5 AS ge FROM part")
def p03(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", (s == 5).alias("eq"), (s != 5).alias("ne"), (s < 5).alias("lt"), (s <= 5).alias("le"), (s > 5).alias("gt"), (s >= 5).alias("ge"))


@query("P04_three_valued", "SELECT p_partkey, nullif(p_size, 5) > 3 AND p_size < 40 AS a, nullif(p_size, 5) > 3 OR p_size < 4 AS o, NOT (nullif(p_size, 5) > 3) AS n FROM part")
def p04(spark, d):
    x, s = F.nullif(F.col("p_size"), F.lit(5)), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", ((x > 3) & (s < 40)).alias("a"), ((x > 3) | (s < 4)).alias("o"), (~(x > 3)).alias("n"))


@query(
    "P05_safe_arith",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE (CAST(l_orderkey AS BIGINT)) // (l_linenumber - 3) END AS q,
    CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE l_orderkey % (l_linenumber - 3) END AS r, CASE WHEN l_linenumber = 1 THEN NULL ELSE 1000000 + CAST(l_linenumber AS BIGINT) END AS s,
    CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE ELSE l_quantity / (l_linenumber - 3) END AS f, -l_linenumber AS m FROM lineitem""",
)
def p05(spark, d):
    install(spark)
    o, k = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    big = F.when(k == 1, F.lit(2**63 - 1)).otherwise(F.lit(1_000_000).cast("long"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        call("divide", o, k - 3).alias("q"), call("remainder", o, k - 3).alias("r"), call("add", big, k).alias("s"), call("fdivide", "l_quantity", (k - 3).cast("double")).alias("f"), (-F.col("l_linenumber")).alias("m"),
    )


@query("P06_concat", "SELECT c_custkey, c_name || ':' || nullif(c_mktsegment, 'BUILDING') AS s FROM customer")
def p06(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(":"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("s"))


@query("P07_is_null", "SELECT p_partkey, nullif(p_size, 7) IS NULL AS a, nullif(p_size, 7) IS NOT NULL AS b FROM part")
def p07(spark, d):
    x = F.nullif(F.col("p_size"), F.lit(7))
    return table(spark, d, "part").select("p_partkey", x.isNull().alias("a"), x.isNotNull().alias("b"))


@query("P08_in", "SELECT p_partkey, p_size IN (1, 2, NULL) AS a, p_size NOT IN (1, 2) AS b FROM part")
def p08(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr("p_size IN (1, 2, NULL)").alias("a"), (~F.col("p_size").isin(1, 2)).alias("b"))


@query("P09_between", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 1000 AND p_size NOT BETWEEN 10 AND 20")
def p09(spark, d):
    return table(spark, d, "part").where(F.col("p_retailprice").between(900, 1000) & ~F.col("p_size").between(10, 20)).select("p_partkey")


@query("P10_like", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_brand LIKE 'Brand#_1' AS b, p_type NOT LIKE 'S%' AS c FROM part")
def p10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").like("%a%").alias("a"), F.col("p_brand").like("Brand#_1").alias("b"), (~F.col("p_type").like("S%")).alias("c"))


@query("P11_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' END AS a, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS b FROM part")
def p11(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "middle").alias("a"), F.when(s == 1, "one").when(s == 2, "two").otherwise("many").alias("b"))


@query("P12_try_cast", "SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS a, try_cast(p_name AS DOUBLE) AS b, CAST(p_size AS VARCHAR) AS c, CAST(p_size AS DOUBLE) AS d FROM part")
def p12(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "[^0-9]", "").try_cast("bigint").alias("a"), F.col("p_name").try_cast("double").alias("b"), F.col("p_size").cast("string").alias("c"), F.col("p_size").cast("double").alias("d"))


@query("P13_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def p13(spark, d):
    c = table(spark, d, "customer")
    return table(spark, d, "orders").join(c.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(c.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("P14_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def p14(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("P14_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def p14n(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("P15_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def p15(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_p15")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM millrace_p15 WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM millrace_p15)")


@query("P15_correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def p15c(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_p15")
    return spark.sql("SELECT o_orderkey FROM millrace_p15 o WHERE o_totalprice = (SELECT max(o_totalprice) FROM millrace_p15 i WHERE i.o_custkey = o.o_custkey)")


@query("P16_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def p16(spark, d):
    install(spark)
    return table(spark, d, "documents").where(call("match", F.col("text"), F.lit("The License"))).select("doc_id")


@query("P17_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def p17(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("millrace_p17")
    return spark.sql("SELECT o_orderkey FROM millrace_p17 WHERE o_orderstatus = ? AND o_totalprice > ?", args=["F", 100000])


# --- joins --------------------------------------------------------------------------------------------------------------


@query("J01_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j01(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("J02_inner_int_key", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j02(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("J03_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def j03(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_quantity") > 45), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("J04_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) o RIGHT JOIN customer ON o_custkey = c_custkey")
def j04(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("J05_full", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) a FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 6000) b ON a.c_custkey = b.c_custkey")
def j05(spark, d):
    c = table(spark, d, "customer")
    a, b = c.where("c_acctbal > 2000").select(F.col("c_custkey").alias("a")), c.where("c_acctbal < 6000").select(F.col("c_custkey").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full")


@query("J06_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j06(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("J07_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j07(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("J08_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def j08(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("J09_multikey", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey")
def j09(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.select(F.col("o_orderkey").alias(k), "o_custkey", "o_orderpriority") for k in "ab")
    return a.join(b, ["o_custkey", "o_orderpriority"]).where("a < b").select("a", "b")


@query("J10_theta", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey AND s.s_acctbal > 5000")
def j10(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 5000").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") > F.col("n_nationkey")).select("s_suppkey", "n_name")


@query(
    "J11_n_way",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
)
def j11(spark, d):
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")
    x = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), rows().alias("n"))


@query("J12_empty_side", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < 0) ON o_custkey = c_custkey")
def j12(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderkey < 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J13_null_keys", "SELECT a.k, count(*) AS n FROM (SELECT nullif(p_size, 1) AS k FROM part) a JOIN (SELECT nullif(p_size, 1) AS j FROM part) b ON a.k = b.j GROUP BY a.k")
def j13(spark, d):
    sizes = table(spark, d, "part").select(F.nullif(F.col("p_size"), F.lit(1)).alias("k")).groupBy("k").agg(rows().alias("m"))  # joined as counts: the pairs of equal sizes are never made
    return sizes.join(sizes.select(F.col("k").alias("j"), F.col("m").alias("w")), F.col("k") == F.col("j")).select("k", (F.col("m") * F.col("w")).alias("n"))


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query("A01_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def a01(spark, d):
    return table(spark, d, "lineitem").agg(rows().alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("A01_empty_global", "SELECT count(*) AS n, sum(CAST(l_linenumber AS DOUBLE)) AS s, max(l_quantity) AS m FROM lineitem WHERE l_orderkey < 0")
def a01e(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey < 0").agg(rows().alias("n"), sum_double(F.col("l_linenumber")).alias("s"), F.max("l_quantity").alias("m"))


@query(
    "A02_group_by",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def a02(spark, d):
    return (
        table(spark, d, "lineitem").where(F.col("l_shipdate") <= ts("2000-09-02")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), rows().alias("n"))
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("A03_group_int_key", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_suppkey")
def a03(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rows().alias("n"), F.round(F.sum("l_quantity"), 2).alias("s"))


@query("A04_count_distinct", "SELECT o_orderstatus, count(*) AS n, count(nullif(o_orderpriority, '1-URGENT')) AS c, count(DISTINCT o_custkey) AS u FROM orders GROUP BY o_orderstatus")
def a04(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(rows().alias("n"), F.count(F.nullif("o_orderpriority", F.lit("1-URGENT"))).alias("c"), F.count_distinct("o_custkey").alias("u"))


@query("A05_sum_double", "SELECT p_brand, sum(CAST(p_size AS DOUBLE)) AS s, sum(CAST(nullif(p_size, p_size) AS DOUBLE)) AS none FROM part GROUP BY p_brand")
def a05(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(sum_double(F.col("p_size")).alias("s"), sum_double(F.nullif("p_size", F.col("p_size"))).alias("none"))


@query("A06_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY c_mktsegment")
def a06(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("a"))


@query("A07_min_max", "SELECT event_type, min(ts) AS t0, max(ts) AS t1, min(props) AS p0, max(value) AS v1 FROM events GROUP BY event_type")
def a07(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("props").alias("p0"), F.max("value").alias("v1"))


@query("A08_sum_distinct", "SELECT l_returnflag, sum(DISTINCT CAST(l_linenumber AS DOUBLE)) AS s, round(avg(DISTINCT l_quantity), 6) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def a08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum_distinct(F.col("l_linenumber").cast("double")).alias("s"), F.round(F.expr("avg(DISTINCT l_quantity)"), 6).alias("a"), rows().alias("n"))


@query("A09_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
def a09(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(rows().alias("n"), F.sum("o_totalprice").alias("s")).where("n > 12 and s > 1000000").select("o_custkey", "n")


@query("A10_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a10(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "A11_analyze",
    """SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS n_nulls, count(DISTINCT o_custkey) AS n_distinct, CAST(min(o_custkey) AS VARCHAR) AS min_value, CAST(max(o_custkey) AS VARCHAR) AS max_value FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders""",
)
def a11(spark, d):
    return analyze(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"]).drop("histogram")


@query(
    "A11_histogram",
    """WITH b AS (SELECT least(9, CAST(floor((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)) / 10)) AS INT)) AS bucket FROM orders)
    SELECT bucket, count(*) AS n FROM b GROUP BY bucket""",
)
def a11h(spark, d):
    return analyze(table(spark, d, "orders"), ["o_totalprice"]).select(F.posexplode("histogram").alias("bucket", "n")).where("n > 0")


@query("A12_group_expression", "SELECT p_size % 7 AS g, round(sum(p_retailprice * p_size), 2) AS s FROM part GROUP BY p_size % 7")
def a12(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_size") % 7).alias("g")).agg(F.round(F.sum(F.col("p_retailprice") * F.col("p_size")), 2).alias("s"))


# --- windows ------------------------------------------------------------------------------------------------------------

def by_user(order: str = "ts"):
    return Window.partitionBy("user_id").orderBy(order)



_OVER = "OVER (PARTITION BY user_id ORDER BY ts)"


def _window(name: str, sql: str, **columns):
    @query(name, f"SELECT event_id, {sql} FROM events")
    def run(spark, d):
        return table(spark, d, "events").select("event_id", *[c().alias(n) for n, c in columns.items()])

    return run


_window("W01_row_number", f"row_number() {_OVER} AS rn", rn=lambda: F.row_number().over(by_user()))
_window("W02_rank", "rank() OVER (PARTITION BY user_id ORDER BY event_type) AS r", r=lambda: F.rank().over(by_user("event_type")))
_window("W03_dense_rank", "dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS r", r=lambda: F.dense_rank().over(by_user("event_type")))
_window("W04_lag", f"lag(value, 1) {_OVER} AS a, lag(value, 3, -1.0) {_OVER} AS b", a=lambda: F.lag("value", 1).over(by_user()), b=lambda: F.lag("value", 3, -1.0).over(by_user()))
_window("W05_lead", f"lead(value, 1) {_OVER} AS a, lead(event_type, 2, 'none') {_OVER} AS b", a=lambda: F.lead("value", 1).over(by_user()), b=lambda: F.lead("event_type", 2, "none").over(by_user()))
_window("W06_first_value", f"first_value(value) {_OVER} AS f", f=lambda: F.first_value("value").over(by_user()))
_window("W07_last_value", "last_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x", x=lambda: F.last_value("value").over(by_user().rowsBetween(0, Window.unboundedFollowing)))
_window("W08_nth_value", f"nth_value(value, 3) {_OVER} AS x", x=lambda: F.nth_value("value", 3).over(by_user()))
_window("W09_count_over", f"count(*) {_OVER} AS n, count(*) OVER (PARTITION BY user_id) AS total", n=lambda: rows().over(by_user()), total=lambda: rows().over(Window.partitionBy("user_id")))
_window("W10_sum_over", f"round(sum(value) {_OVER}, 4) AS s", s=lambda: F.round(F.sum("value").over(by_user()), 4))
_window("W11_avg_over", f"round(avg(value) {_OVER}, 9) AS a", a=lambda: F.round(F.avg("value").over(by_user()), 9))
_window("W12_min_max", f"min(value) {_OVER} AS lo, max(value) {_OVER} AS hi", lo=lambda: F.min("value").over(by_user()), hi=lambda: F.max("value").over(by_user()))
_window(
    "W13_rows_frame", "round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n",
    s=lambda: F.round(F.sum("value").over(by_user().rowsBetween(-2, 1)), 4), n=lambda: rows().over(by_user().rowsBetween(Window.unboundedPreceding, -1)),
)
_window("W13_range_frame", "count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n", n=lambda: rows().over(by_user("event_id").rangeBetween(-500, 500)))


@query("W14_groups_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
def w14(spark, d):
    return over_groups(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_type"], -1, 0, n=rows()).select("event_id", "n")


# --- sorts and limits -----------------------------------------------------------------------------------------------------


@query("O01_order_by", "SELECT p_partkey, nullif(p_size, 3) AS s FROM part ORDER BY s NULLS FIRST, p_partkey DESC")
def o01(spark, d):
    return table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(3)).alias("s")).orderBy(F.asc("s"), F.desc("p_partkey"))


@query("O02_topk", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def o02(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("O03_sort_int", "SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def o03(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey")


@query("O05_limit", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 10)")
def o05(spark, d):
    return table(spark, d, "orders").select("o_orderkey").limit(10).agg(rows().alias("n"))


@query("O08_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
def o08(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").offset(30).limit(20)


# --- set operations ---------------------------------------------------------------------------------------------------------


def _status(spark, d, s):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == s).select("o_custkey")


def _q(s):
    return f"SELECT o_custkey FROM orders WHERE o_orderstatus = '{s}'"


@query("U01_union_all", f"{_q('F')} UNION ALL {_q('O')}")
def u01(spark, d):
    return _status(spark, d, "F").unionAll(_status(spark, d, "O"))


@query("U02_union", f"{_q('F')} UNION {_q('O')} UNION {_q('P')}")
def u02(spark, d):
    return _status(spark, d, "F").union(_status(spark, d, "O")).union(_status(spark, d, "P")).distinct()


@query("U03_intersect", f"{_q('F')} INTERSECT {_q('O')}")
def u03(spark, d):
    return _status(spark, d, "F").intersect(_status(spark, d, "O"))


@query("U04_except", f"{_q('F')} EXCEPT {_q('O')}")
def u04(spark, d):
    return _status(spark, d, "F").subtract(_status(spark, d, "O"))


@query("U05_order_limit", f"SELECT o_custkey FROM ({_q('F')} UNION {_q('O')}) ORDER BY o_custkey DESC LIMIT 25")
def u05(spark, d):
    return _status(spark, d, "F").union(_status(spark, d, "O")).distinct().orderBy(F.desc("o_custkey")).limit(25)
