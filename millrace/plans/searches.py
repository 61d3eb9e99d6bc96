"""Vector, text and hybrid search queries, and document chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import search, tokenizer
from millrace.operators.tables import Catalog
from millrace.operators.text_index import TextIndex
from millrace.operators.vector_index import VectorIndex
from millrace.plans.registry import query, table
from millrace.session import fresh_path
from millrace.sources.readers import chunk_documents

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')"
QUERY = "the license of data"


def _vector(spark, d, vec_id: int) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


_V0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
_L2 = f"list_distance(CAST(embedding AS DOUBLE[]), {_V0})"


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 6))


@query("V04_metric_ip", f"SELECT vec_id AS row_id, round(-list_inner_product(CAST(embedding AS DOUBLE[]), {_V0}), 6) AS distance FROM embeddings ORDER BY -list_inner_product(CAST(embedding AS DOUBLE[]), {_V0}), vec_id LIMIT 10")
def v04(spark, d):
    return _rounded(search.vector_search(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, metric="ip"))


@query("V04_metric_cosine", f"SELECT vec_id AS row_id, round(-list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0}), 6) AS distance FROM embeddings ORDER BY -list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_V0}), vec_id LIMIT 10")
def v04c(spark, d):
    return _rounded(search.vector_search(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, metric="cosine"))


@query("V05_knn", f"SELECT vec_id AS row_id, round({_L2} * {_L2}, 6) AS distance FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10")
def v05(spark, d):
    return _rounded(search.vector_search(table(spark, d, "embeddings"), _vector(spark, d, 0), 10))


_BATCH = """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, row_id) AS rank FROM p) SELECT query_id, row_id, round(x * x, 6) AS distance, rank FROM r WHERE rank <= 5"""


@query("V05_knn_batch", _BATCH)
def v05b(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the stated query set
    return _rounded(search.vector_search_table(e, queries, 5))


@query("V02_inverted_file_exact", _BATCH)
def v02(spark, d):
    """An index of the whole table, searched in all of its cells, which is the exact way."""
    e = table(spark, d, "embeddings")
    index = VectorIndex.build(e, fresh_path(spark, "ivf"), cells=24)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded(index.search_many(queries, 5, probe=24))


@query("V01_inverted_file", "SELECT CAST(24 AS BIGINT) AS cells, count(*) AS n, count(DISTINCT vec_id) AS ids, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 3) AS s FROM embeddings")
def v01(spark, d):
    """Every vector is in one cell of the index."""
    path = fresh_path(spark, "ivf")
    index = VectorIndex.build(table(spark, d, "embeddings"), path, cells=24)
    return spark.read.parquet(f"{path}/rows").where("cell >= 0").agg(F.lit(len(index.centres)).cast("long").alias("cells"), F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.round(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)), 3).alias("s"))


@query("V03_search_trace", f"SELECT 24 AS cells, len(range(24)) AS visited, (SELECT count(*) FROM embeddings) AS compared, unnest(range(5)) AS place, unnest((SELECT list(vec_id ORDER BY {_L2}, vec_id)[1:5] FROM embeddings)) AS row_id")
def v03(spark, d):
    index = VectorIndex.build(table(spark, d, "embeddings"), fresh_path(spark, "ivf"), cells=24)
    t = index.trace(_vector(spark, d, 0), 5, probe=24)
    return t.select("cells", F.size("visited").cast("long").alias("visited"), "compared", F.posexplode("top").alias("place", "row_id")).withColumn("place", F.col("place").cast("long"))


@query("T01_segments", r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+|[\s\x{85}\p{Z}]+|\p{L}+|[[:punct:]\x{2000}-\x{206F}]+|[^0-9\s\x{85}\p{Z}\p{L}[:punct:]\x{2000}-\x{206F}]+')) AS s FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'digit' WHEN regexp_matches(s, '^[\s\x{85}\p{Z}]') THEN 'space' WHEN regexp_matches(s, '^\p{L}') THEN 'letter' WHEN regexp_matches(s, '^[[:punct:]\x{2000}-\x{206F}]') THEN 'punct' ELSE 'symbol' END AS class,
    count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM s GROUP BY ALL""")
def t01(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(tokenizer.segments("text")).alias("s"))
    return s.groupBy("doc_id", tokenizer.class_of(F.col("s")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query("T01_merges", "SELECT doc_id, length(text) - (length(text) - length(replace(text, 'th', ''))) // 2 - (length(text) - length(replace(text, 'the', ''))) // 3 AS n, (length(text) - length(replace(text, 'the', ''))) // 3 AS the FROM documents")
def t01m(spark, d):
    """Every character is a token but where t and h, and then th and e, merge."""
    t = tokenizer.encode(table(spark, d, "documents").select("doc_id", "text"), {"the": 7}, [("t", "h"), ("th", "e")])
    return t.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x == 7)).cast("long").alias("the"))


@query("V07_filtered_knn", f"SELECT vec_id AS row_id, round({_L2} * {_L2}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_L2}, vec_id LIMIT 10")
def v07(spark, d):
    return _rounded(search.vector_search(table(spark, d, "embeddings"), _vector(spark, d, 0), 10, where="label = 3"))


@query("T02_tokens", f"SELECT doc_id, CAST(len({TOKENS}) AS INT) AS n, coalesce({TOKENS}[1], '') AS first_token FROM documents")
def t02(spark, d):
    t = search.tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("first_token"))


@query("T03_postings", f"SELECT token, doc_id, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len({TOKENS}) AS n, unnest({TOKENS}) AS token FROM documents) GROUP BY token, doc_id")
def t03(spark, d):
    return search.postings(table(spark, d, "documents"))


@query("T03_inverted_and", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'the') AND list_contains({TOKENS}, 'license')")
def t03a(spark, d):
    return search.search_tokens(table(spark, d, "documents"), "license the", mode="and")


@query("T03_inverted_or", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'license') OR list_contains({TOKENS}, 'daten')")
def t03o(spark, d):
    return search.search_tokens(table(spark, d, "documents"), "license Daten", mode="or")


_BM25 = f"""t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
q AS (SELECT unnest(['the', 'license', 'of', 'data']) AS w),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
f AS (SELECT doc_id, w, len(t) AS dl, len(list_filter(t, lambda x: x = w)) AS tf FROM t, q),
g AS (SELECT w, count(*) AS df FROM f WHERE tf > 0 GROUP BY w),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM f JOIN g USING (w), n WHERE tf > 0 GROUP BY doc_id)"""


@query("T04_bm25", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def t04(spark, d):
    return search.bm25(table(spark, d, "documents"), QUERY, None).select("doc_id", F.round("score", 6).alias("score"))


@query("T10_index_changes", "WITH RECURSIVE docs AS (SELECT * FROM documents WHERE lang <> 'fr' OR source = 'src0'), " + _BM25.replace("FROM documents", "FROM docs") + " SELECT doc_id, round(score, 6) AS score FROM bm")
def t10(spark, d):
    """An index that follows deletes and inserts: French documents go, and those of one source come back."""
    docs = table(spark, d, "documents")
    index = TextIndex(Catalog(spark, fresh_path(spark, "db")), "docs")
    index.add(docs)
    index.remove(docs.where("lang = 'fr'").select("doc_id"))
    index.add(docs.where("lang = 'fr' and source = 'src0'"))
    return index.bm25(QUERY, None).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "T05_fuzzy_edit",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    s AS (SELECT doc_id, greatest(len(t), 5) AS longer, array_to_string(list_transform(t, lambda x: CASE x WHEN 'released' THEN 'a' WHEN 'under' THEN 'b' WHEN 'the' THEN 'c' WHEN 'mit' THEN 'd' WHEN 'license' THEN 'e' ELSE 'z' END), '') AS s
      FROM t WHERE list_has_any(t, ['released', 'under', 'the', 'mit', 'license']) AND abs(len(t) - 5) <= greatest(len(t), 5) // 2 + 1),
    x AS (SELECT doc_id, longer, levenshtein(s, 'abcde') AS d, CASE WHEN s LIKE 'abcde%' THEN 5 WHEN s LIKE 'abcd%' THEN 4 WHEN s LIKE 'abc%' THEN 3 WHEN s LIKE 'ab%' THEN 2 WHEN s LIKE 'a%' THEN 1 ELSE 0 END AS p FROM s)
    SELECT doc_id, round(least(1.0, 1.0 - d / longer + 0.1 * p / 5), 9) AS similarity FROM x WHERE d <= longer // 2 + 1""",
)
def t05(spark, d):
    return search.fuzzy_edit(table(spark, d, "documents"), "released under the mit license", None).select("doc_id", F.round("similarity", 9).alias("similarity"))


@query(
    "T06_ngram",
    f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t),
    s AS (SELECT doc_id, len(list_intersect(g, ['released under', 'under the', 'the mit', 'mit license'])) AS b, len(g) AS n FROM g)
    SELECT doc_id, round(b / (n + 4 - b), 9) AS similarity FROM s WHERE b > 0""",
)
def t06(spark, d):
    return search.fuzzy_ngram(table(spark, d, "documents"), "released under the MIT license", None).select("doc_id", F.round("similarity", 9).alias("similarity"))


#: Pieces of at most 500 characters of a table w (doc_id, k, title, text), that end after a space, with 50 of overlap: doc_id, k, title, n, content.
_PIECES = """c AS (
      SELECT doc_id, k, title, text, 0 AS n, 0 AS a, CAST(0 AS BIGINT) AS e FROM w WHERE length(text) > 0
      UNION ALL SELECT doc_id, k, title, text, n + 1, CASE WHEN n = 0 THEN 0 ELSE greatest(e - 50, a + 1) END,
        CASE WHEN x + 500 < length(text) AND strpos(substr(text, x + 1, 500), ' ') > 0 THEN x + length(substr(text, x + 1, 500)) - strpos(reverse(substr(text, x + 1, 500)), ' ') + 1 ELSE least(x + 500, length(text)) END
      FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(e - 50, a + 1) END AS x FROM c) WHERE n = 0 OR e < length(text)),
    p AS (SELECT doc_id, k, title, n, substr(text, a + 1, e - a) AS content FROM c WHERE n > 0 AND regexp_matches(substr(text, a + 1, e - a), '\\S'))"""


@query("T07_chunk", f"WITH RECURSIVE w AS (SELECT doc_id, 0 AS k, '' AS title, text FROM documents), {_PIECES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS chunk_no, title, content FROM p")
def t07(spark, d):
    return chunk_documents(table(spark, d, "documents"), size=500, overlap=50)


@query(
    "T07_chunk_markdown",
    f"""WITH RECURSIVE h AS (SELECT doc_id, string_split_regex(text, '(?m)^#{{1,6}}[ \\t]+.*$') AS s, list_prepend('', regexp_extract_all(text, '(?m)^#{{1,6}}[ \\t]+(.*?)[ \\t]*#*[ \\t]*$', 1)) AS t FROM documents),
    u AS (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM h),
    w AS (SELECT doc_id, k, t[k] AS title, trim(s[k], chr(10)) AS text FROM u WHERE t[k] <> '' OR regexp_matches(s[k], '\\S')), {_PIECES},
    e AS (SELECT doc_id, k, title, n, content FROM p UNION ALL SELECT doc_id, k, title, 1, '' FROM w WHERE (doc_id, k) NOT IN (SELECT (doc_id, k) FROM p))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, n) - 1 AS INT) AS chunk_no, title, content FROM e""",
)
def t07m(spark, d):
    return chunk_documents(table(spark, d, "documents"), size=500, overlap=50, markdown=True)


_RRF = """WITH a AS (SELECT o_custkey AS doc_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 50),
b AS (SELECT c_custkey AS doc_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id"""


@query("T08_rrf", _RRF)
def t08(spark, d):
    a = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    b = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    a = search.with_rank(a, F.desc("o_totalprice"), F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), "rank")
    b = search.with_rank(b, F.desc("c_acctbal"), F.col("c_custkey")).select(F.col("c_custkey").alias("doc_id"), "rank")
    return search.rrf([a, b], None).select("doc_id", F.round("score", 9).alias("score"))


@query(
    "T09_hybrid",
    f"""WITH {_BM25}, s AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 30),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS rank FROM embeddings QUALIFY row_number() OVER (ORDER BY {_L2}, vec_id) <= 30)
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM v) GROUP BY doc_id ORDER BY sum(1.0 / (60 + rank)) DESC, doc_id LIMIT 10""",
)
def t09(spark, d):
    return search.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), QUERY, _vector(spark, d, 0), 10).select("doc_id", F.round("score", 9).alias("score"))
