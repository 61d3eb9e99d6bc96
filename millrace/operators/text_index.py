"""A full-text index that is kept over inserts and deletes: postings in versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.search import B, K1, postings, tokenize
from millrace.operators.tables import Catalog, ColumnDef


class TextIndex:
    """Postings (token, doc_id, tf, doc_len, batch), clustered by token so that a query reads only the row groups of its tokens; and what is dead of them.

    Rows that are added have a batch number. Deleting a document appends it to the dead list with the last batch so far: older postings of it do not count, and those of a
    document that is added again do. compact() drops the dead. Each change is one transaction, so readers see postings and dead list of one version.
    """

    def __init__(self, catalog: Catalog, name: str, id_type: str = "bigint"):
        self.catalog, self.postings, self.docs, self.dead = catalog, f"{name}_postings", f"{name}_docs", f"{name}_dead"
        if self.postings not in catalog.tables():
            catalog.create(self.postings, [ColumnDef("token", "string"), ColumnDef("doc_id", id_type), ColumnDef("tf", "bigint"), ColumnDef("doc_len", "bigint"), ColumnDef("batch", "bigint")])
            catalog.create(self.docs, [ColumnDef("doc_id", id_type), ColumnDef("doc_len", "bigint"), ColumnDef("batch", "bigint")])
            catalog.create(self.dead, [ColumnDef("doc_id", id_type), ColumnDef("batch", "bigint")])

    def _batch(self) -> int:
        return (self.catalog.read(self.docs).agg(F.max("batch")).first()[0] or 0) + 1

    def add(self, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> None:
        batch = F.lit(self._batch()).cast("long").alias("batch")
        p = postings(df, id_col=id_col, text_col=text_col).select("token", "doc_id", "tf", "doc_len", batch)
        from millrace.operators.search import tokens

        docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.size(tokens(F.col(f"`{text_col}`"))).cast("long").alias("doc_len"), batch)
        with self._change():
            self.catalog.insert(self.postings, p.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id"))
            self.catalog.insert(self.docs, docs)

    def remove(self, ids: DataFrame) -> None:
        """ids: one column of document ids."""
        with self._change():
            self.catalog.insert(self.dead, ids.select(F.col(ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct().withColumn("batch", F.lit(self._batch() - 1).cast("long")))

    def _change(self):
        return _Transaction(self.catalog)

    def _alive(self, df: DataFrame) -> DataFrame:
        dead = self.catalog.read(self.dead).groupBy("doc_id").agg(F.max("batch").alias("last")).select(F.col("doc_id").alias("gone"), "last")
        return df.join(dead, (df.doc_id == dead.gone) & (df.batch <= dead.last), "left_anti")

    def compact(self) -> None:
        live, docs = self._alive(self.catalog.read(self.postings)), self._alive(self.catalog.read(self.docs))
        with self._change():
            self.catalog.replace(self.postings, live.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id"))
            self.catalog.replace(self.docs, docs)
            self.catalog.truncate(self.dead)

    def search(self, query: str, mode: str = "or") -> DataFrame:
        """doc_id of every document with any (or all) of the query's tokens."""
        wanted = list(dict.fromkeys(tokenize(query)))
        hits = self._alive(self.catalog.read(self.postings).where(F.col("token").isin(wanted or [""]))).groupBy("doc_id").agg(F.count_distinct("token").alias("n"))
        return hits.where(F.col("n") >= (len(wanted) if mode == "and" else 1)).select("doc_id")

    def bm25(self, query: str, k: int | None = 10, *, k1: float = K1, b: float = B) -> DataFrame:
        """doc_id and score, as search.bm25 over the documents that are there; only the query's postings and the documents' lengths are read."""
        wanted = list(dict.fromkeys(tokenize(query)))
        s = self._alive(self.catalog.read(self.docs)).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("len")).first()
        n, mean = s["n"] or 0, (s["len"] or 0) / max(s["n"] or 0, 1) or 1.0
        p = self._alive(self.catalog.read(self.postings).where(F.col("token").isin(wanted or [""])))
        df = {r.token: r.n for r in p.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # the query's tokens
        if not df:
            return p.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        idf = F.element_at(F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, float(c))]), F.col("token"))
        tf = F.col("tf").cast("double")
        score = F.log(1 + (n - idf + 0.5) / (idf + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / mean))
        out = p.select("doc_id", score.alias("s")).groupBy("doc_id").agg(F.sum("s").alias("score"))
        return out.orderBy(F.desc("score"), "doc_id").limit(k) if k is not None else out


class _Transaction:
    """One transaction around a change, unless the caller has one open."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.own = catalog, not catalog.in_transaction

    def __enter__(self):
        if self.own:
            self.catalog.begin()

    def __exit__(self, kind, *_):
        if self.own:
            self.catalog.rollback() if kind else self.catalog.commit()
