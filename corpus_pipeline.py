"""A training corpus from documents: five stages, each of which works on all that the one before it kept.

All stages but the last return the columns of documents, whatever they are called, and take null or repeated ids, null, empty and very long texts and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, mixing, neardup, quality_clf, secrets
from millrace.llm.common import crc_mod, free_name, fresh_path, read, remove, scratch

#: Documents under this score go. Clean documents matter more than the last bad one, so it is the contract's low cutoff.
CUTOFF = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the compression classifier accepts; it learns from labels as op10 does.

    A null or empty text has the score of an empty one, so all of them stay or go alike, as repeated rows do. Without labels every score is 0.5 and all stay.
    """
    labels = read(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = quality_clf.fit(read(spark, sf_dir, "documents"), labels)
    flagged = quality_clf.score_quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text")), model, keep=["row"])
    return flagged.where(F.col("score") >= CUTOFF).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts that are null or empty and rows without an id are nobody's duplicates and stay; rows that repeat a kept id become one.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go alike; without a benchmark all stay."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, with secrets masked in their texts and n_chars brought up to date. Null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many (taken) and where in its order (virtual_finish). Texts without words give none.

    The order stands in virtual_finish; the rows are not sorted by it once more, as that would shuffle all texts again.
    """
    return mixing.mix(docs, carry=docs.columns, ordered=False).where(f"{free_name('taken', docs.columns)} > 0")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("mixing", mixture),
]

#: SQL cannot say what the classifier and the sketches do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes when it has ended, and its result when the next one has."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
