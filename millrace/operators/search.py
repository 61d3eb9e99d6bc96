"""Vector, full-text and hybrid search over whole tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.batches import parts, prepare, trimmed
from millrace.functions.dialect import call, install

#: Runs of letters, digits, underscores and hyphens, lower-cased.
TOKEN = r"([\p{L}\p{N}_-]+)"
_IN, _OUT = r"(?<![\p{L}\p{N}_-])", r"(?![\p{L}\p{N}_-])"  # a token begins and ends here
K1, B = 1.2, 0.75
RRF_K = 60
#: Query vectors that a task compares with a batch at once, and that are sent to the workers for one pass over the rows.
QUERY_BLOCK, QUERY_PASS = 256, 4096
METRICS = {"l2": lambda a, b: call("vector_l2_squared", a, b), "ip": lambda a, b: -call("vector_inner", a, b), "cosine": lambda a, b: -call("vector_cosine_similarity", a, b)}


def vector_literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def vector_search(df: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2", where: Column | str | None = None) -> DataFrame:
    """The k nearest rows to a query vector: row_id, distance (squared L2, or negated inner product or cosine), nearest first, then by id.

    Exact: a filter, if any, comes before the ranking. Each partition keeps its k best (TakeOrderedAndProject), so k rows a task reach the driver.
    Rows of other dimensions have no distance and are left out.
    """
    install(df.sparkSession)
    rows = df if where is None else df.where(where)
    out = rows.select(F.col(f"`{id_col}`").alias("row_id"), METRICS[metric](F.col(f"`{vec_col}`"), vector_literal(query)).alias("distance")).where("distance is not null")
    return out.orderBy("distance", "row_id").limit(k)


def vector_search_many(df: DataFrame, queries: list[tuple[int, list[float]]], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """query_id, row_id, distance and rank of the k nearest rows to each of a stated list of queries.

    Every row is compared with the queries block by block, in numpy on Arrow batches. Each task keeps k rows a query of what it has seen (a running merge, bounded
    by queries times k), so only these are shuffled for the last ranking.
    """
    import numpy as np
    import pyarrow as pa

    qid, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], float)
    shared = df.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches):
        ids, qv = shared.value
        best_d = [np.zeros(0)] * len(ids)
        best_r = [np.zeros(0, np.int64)] * len(ids)
        for b in batches:
            fits = np.nonzero(b.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == qv.shape[1])[0] if len(ids) else []
            if not len(fits):
                continue
            x = b.column(1).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), -1)
            r = b.column(0).to_numpy(zero_copy_only=False)[fits].astype(np.int64)
            for a in range(0, len(ids), QUERY_BLOCK):
                part = qv[a : a + QUERY_BLOCK]
                if metric == "l2":
                    d = np.stack([((x - y) ** 2).sum(1) for y in part])
                else:
                    d = -(part @ x.T)
                    if metric == "cosine":
                        n = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                        d = np.divide(d, n, out=np.zeros_like(d), where=n > 0)
                for j, row in enumerate(d):
                    dd, rr = np.concatenate([best_d[a + j], row]), np.concatenate([best_r[a + j], r])
                    keep = np.lexsort((rr, dd))[:k]
                    best_d[a + j], best_r[a + j] = dd[keep], rr[keep]
        if len(ids):
            n = [len(x) for x in best_d]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best_r)), pa.array(np.concatenate(best_d))], names=["query_id", "row_id", "distance"])

    near = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`").cast("array<double>")).mapInArrow(run, "query_id long, row_id long, distance double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "row_id"))).where(F.col("rank") <= k)


def vector_search_table(df: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    """vector_search_many for a table of queries (query_id, vector) of any size: blocks of QUERY_PASS come to the driver one after the other, each for one pass over the rows."""
    from millrace.session import written

    out, block = None, []

    def passed(block):
        found = vector_search_many(df, block, k, **how)
        return written(found, "near")

    for r in queries.select("query_id", "vector").toLocalIterator():
        block.append((r[0], list(r[1])))
        if len(block) == QUERY_PASS:
            out, block = passed(block) if out is None else out.unionAll(passed(block)), []
    if block or out is None:
        last = passed(block) if out is not None else vector_search_many(df, block, k, **how)
        out = last if out is None else out.unionAll(last)
    return out


# --- text -----------------------------------------------------------------------------------------------------------


def tokens(text: Column | str) -> Column:
    """The tokens of a text, in order; a NULL text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN)), F.array().cast("array<string>"))


def once(value: Column, fn) -> Column:
    """fn of a value that is computed once a row: as a lambda's variable it is not worked out anew wherever fn names it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def _is(word: str):
    return lambda x: x == F.lit(word)


def tokenize(query: str) -> list[str]:
    """The same for one query text, on the driver."""
    import regex

    return regex.findall(r"[\p{L}\p{N}_-]+", query.lower())


def postings(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """token, doc_id, tf, doc_len: the inverted index. With only, just these tokens' postings are made.

    A row's tokens are counted where the row is, so no posting is shuffled, unless some id has more rows than one: ids are counted first.
    """
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), tokens(F.col(f"`{text_col}`")).alias("t"))
    d = d.withColumn("doc_len", F.size("t").cast("long"))
    if only is not None:
        d = d.withColumn("t", F.filter("t", lambda x: x.isin(list(dict.fromkeys(only)) or [""])))
    prepare(df.sparkSession)
    schema = T.StructType([T.StructField("token", T.StringType()), d.schema["doc_id"], T.StructField("tf", T.LongType()), T.StructField("doc_len", T.LongType())])
    p = d.mapInArrow(lambda batches: trimmed(_counted(batches)), schema)
    shared_id = df.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if shared_id.isEmpty():
        return p
    return p.groupBy("token", "doc_id").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, doc_id, tf and doc_len of each distinct token of each row (doc_id, t, doc_len)."""
    for b in batches:
        for part in parts(b):
            at, found, times = [], [], []
            for i, t in enumerate(part.column(1)):
                n = Counter(t.as_py())
                at += [i] * len(n)
                found += n
                times += n.values()
            if at:
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.column(0).take(at), pa.array(times, pa.int64()), part.column(2).take(at)], names=["token", "doc_id", "tf", "doc_len"])


def search_tokens(df: DataFrame, query: str, *, mode: str = "or", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id of every document with any (or all) of the query's tokens. One scan, no shuffle."""
    wanted = list(dict.fromkeys(tokenize(query)))
    t = tokens(F.col(f"`{text_col}`"))
    hit = F.lit(False) if not wanted else F.arrays_overlap(t, F.array(*map(F.lit, wanted))) if mode == "or" else F.size(F.array_except(F.array(*map(F.lit, wanted)), t)) == 0
    return df.where(hit).select(F.col(f"`{id_col}`").alias("doc_id"))


def bm25(df: DataFrame, query: str, k: int | None = 10, *, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """doc_id and score of the k best documents (all that match, if None) by BM25 over any of the query's tokens; ties by id.

    Term frequencies are counted inside each row, so no posting is shuffled: what is gathered first is a single row of document count,
    total length and document frequencies, and k rows a task at the end. A query token that is repeated counts once.
    """
    wanted = list(dict.fromkeys(tokenize(query)))
    if not wanted:
        return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.col(f"`{text_col}`"))
    hits = F.regexp_extract_all(low, F.lit(f"{_IN}({'|'.join(sorted(wanted, reverse=True))}){_OUT}"))  # tokens have no signs that a pattern takes otherwise
    counted = once(hits, lambda t: F.struct(*[F.size(F.filter(t, _is(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]))
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.regexp_count(low, F.lit(TOKEN)), F.lit(0)).alias("doc_len"), counted.alias("c")).select("doc_id", "doc_len", *[F.coalesce(f"c.tf{i}", F.lit(0)).alias(f"tf{i}") for i in range(len(wanted))])
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))]).first()
    n, mean = stats["n"] or 0, (stats["len"] or 0) / max(stats["n"] or 0, 1) or 1.0
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf = F.col(f"tf{i}").cast("double")
        idf = F.log(F.lit(1.0 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / mean))
    hit = F.lit(False)
    for i in range(len(wanted)):
        hit = hit | (F.col(f"tf{i}") > 0)
    out = d.where(hit).select("doc_id", score.alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k is not None else out


def edit_distance(a: list[str], b: list[str]) -> int:
    """The standard edit distance of token lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_similarity(a: list[str], b: list[str]) -> float | None:
    """1 - distance / longer length, and a tenth of the share of the query a that b begins with, 1 at most; None if half of the longer and one more are to be changed."""
    longer, prefix = max(len(a), len(b)), 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        prefix += 1
    d = edit_distance(a, b)
    return None if not b or d > longer // 2 + 1 else min(1.0, 1.0 - d / longer + 0.1 * prefix / max(len(a), 1))


def fuzzy_edit(df: DataFrame, query: str, k: int | None = 10, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """doc_id and similarity (see edit_similarity) of the documents with a token of the query whose token lists are nearest to the query's.

    Each of the query's tokens stands for one letter and all other tokens for one more, which changes no distance; so lists are compared as strings by the JVM's
    edit distance. Documents whose length alone is too far from the query's never get there.
    """
    wanted = tokenize(query)
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.lower(F.col(f"`{text_col}`")).alias("low"))
    if not wanted:
        return d.limit(0).select("doc_id", F.lit(0.0).alias("similarity"))
    letters = {w: chr(0x4E00 + i) for i, w in enumerate(dict.fromkeys(wanted))}
    n, longer = len(wanted), F.greatest(F.col("n"), F.lit(len(wanted)))
    d = d.where(F.col("low").rlike(f"{_IN}({'|'.join(sorted(letters, reverse=True))}){_OUT}")).withColumn("n", F.regexp_count("low", F.lit(TOKEN)))
    most = F.floor(longer / 2).cast("int") + 1
    d = d.where(F.abs(F.col("n") - n) <= most)
    known = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    d = d.withColumn("s", F.concat_ws("", F.transform(tokens(F.col("low")), lambda t: F.coalesce(F.element_at(known, t), F.lit("#")))))
    own = "".join(letters[w] for w in wanted)
    prefix = F.lit(0)
    for i in range(n, 0, -1):
        prefix = F.when(F.col("s").startswith(own[:i]), i).otherwise(prefix) if i == n else F.when(prefix > 0, prefix).otherwise(F.when(F.col("s").startswith(own[:i]), i).otherwise(0))
    d = d.withColumn("distance", F.levenshtein("s", F.lit(own))).where(F.col("distance") <= most)
    out = d.select("doc_id", F.least(F.lit(1.0), 1.0 - F.col("distance") / longer + 0.1 * prefix / n).alias("similarity")).where(F.col("similarity") >= least)
    return out.orderBy(F.desc("similarity"), "doc_id").limit(k) if k is not None else out


def ngrams(t: Column, n: int) -> Column:
    """The distinct runs of n tokens, joined by spaces; a shorter list has none."""
    return F.array_distinct(F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>")))


def fuzzy_ngram(df: DataFrame, query: str, k: int | None = 10, *, n: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and Jaccard similarity of the k documents whose n-gram sets are nearest to the query's."""
    words = tokenize(query)
    own = list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
    q = F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")
    if own:  # only where one of them stands are all of a text's n-grams made
        apart = r"[^\p{L}\p{N}_-]+"
        df = df.where(F.lower(F.col(f"`{text_col}`")).rlike(_IN + "(" + "|".join(apart.join(g.split(" ")) for g in own) + ")" + _OUT))
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), once(once(tokens(F.col(f"`{text_col}`")), lambda t: ngrams(t, n)), lambda g: F.struct(F.size(g).alias("n"), F.size(F.array_intersect(g, q)).alias("both"))).alias("c")).select("doc_id", "c.*")
    out = d.where("both > 0").select("doc_id", (F.col("both") / (F.col("n") + len(own) - F.col("both"))).alias("similarity"))
    return out.orderBy(F.desc("similarity"), "doc_id").limit(k) if k is not None else out


def rrf(ranked: list[DataFrame], k: int | None = 10, *, id_col: str = "doc_id", rank_col: str = "rank", constant: int = RRF_K) -> DataFrame:
    """doc_id and score = sum of 1 / (constant + rank) over ranked lists (ranks from 1)."""
    every = None
    for r in ranked:
        part = r.select(F.col(id_col).alias("doc_id"), (1.0 / (constant + F.col(rank_col))).alias("s"))
        every = part if every is None else every.unionAll(part)
    out = every.groupBy("doc_id").agg(F.sum("s").alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k is not None else out


def with_rank(top: DataFrame, *order: Column) -> DataFrame:
    """A top-k list with its ranks. The window has one partition, of k rows."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", vec_id: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """BM25's and the vectors' 3k best each, fused by reciprocal rank to k."""
    sparse = with_rank(bm25(docs, query, 3 * k, id_col=id_col, text_col=text_col), F.desc("score"), F.col("doc_id"))
    dense = with_rank(vector_search(vectors, vector, 3 * k, id_col=vec_id, vec_col=vec_col, metric=metric), F.col("distance"), F.col("row_id")).withColumnRenamed("row_id", "doc_id")
    return rrf([sparse, dense], k)
