"""The corpus pipeline: each stage against a brute-force version over its own input."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontam, queries, secrets
from tests.test_oracle import rows
from tests.llm.test_operators import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's output, written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"file://{at}/{k}")
        docs = spark.read.parquet(f"file://{at}/{k}")
        out.append(docs)
    return out


def test_columns(spark, sf, stages):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(s.columns == names for s in stages[:-1]) and set(names) <= set(stages[-1].columns)


def test_each_stage_decides(spark, sf, stages):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = [{r.doc_id: r.text for r in s.collect()} for s in stages]
    scores = {r.doc_id: r.score for r in queries.op10_quality_score(spark, sf).collect()}
    assert set(after[0]) == {i for i in docs if scores[i] >= corpus_pipeline.CUTOFF}
    component = brute_components(list(after[0].items()))
    assert set(after[1]) == {i for i in after[0] if component[i][1] == i}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r.doc_id for r in decontam.find_contamination(stages[1], bench).collect()}
    assert set(after[2]) == set(after[1]) - hit
    assert after[3] == {i: secrets.redact_text(t) for i, t in after[2].items()}
    assert set(after[4]) <= set(after[3]) and all(r.n_chars == len(r.text) for r in stages[3].collect() if r.text != after[2][r.doc_id])


def test_run(spark, sf, stages):
    assert rows(corpus_pipeline.run(spark, sf).toPandas()) == rows(stages[-1].toPandas())


ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t ", "en", "web", 3), (4, "long words go on " * 9000, "en", "web", 9), (5, "plain words here and more of them", "en", "web", 16),
    (5, "plain words here and more of them", "en", "web", 16), (None, "a row without an id", "en", None, 19), (None, None, None, None, None), (7, "password = 'Zx9$kQ!72mLp' déjà vu", "fr", "b`c", 15),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, sf, tmp_path, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, ties, clashing names, and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(ODD, schema)
    for c in ("row", "score", "hit", "taken", "size", "weight", "redacted", "kept_id", "key"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns if name == "mixing" else out.columns == docs.columns
    got = out.collect()
    assert all(r["row"] == r["score"] == r["hit"] == r["taken"] == r["size"] == r["weight"] == r["redacted"] == r["kept_id"] == r["key"] == "clash" for r in got)
    n = {"quality classifier": None, "near-duplicates": len(ODD) - 1, "decontamination": len(ODD), "secret scan": len(ODD), "mixing": None}[name]
    assert len(got) == n if n is not None else 0 < len(got) <= len(ODD)
    if name == "quality classifier":  # equal texts share their fate
        assert len({r.doc_id in {x.doc_id for x in got} for r in docs.where("coalesce(text, '') = '' and doc_id is not null").collect()}) == 1
    if name == "secret scan":
        assert {r.text for r in got if r.doc_id == 7} == {"password = '[secret]' déjà vu"}
    assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    a, b = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    for df in (a, b):
        for c in df.columns:
            if pd.api.types.is_float_dtype(df[c]):
                df[c] = df[c].round(6)
    assert rows(a) == rows(b)
