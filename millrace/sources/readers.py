"""Readers, writers and document ingestion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.batches import PART_BYTES, parts, prepare, trimmed


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and content of whole text or Markdown files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """A DataFrame of a pyarrow Table: columns in bulk, no row objects."""
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    """A pyarrow Table of a result that fits the driver."""
    return df.toArrow()


def to_ipc(df: DataFrame) -> bytes:
    """An Arrow IPC stream of a result that fits the driver."""
    t, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


_HEADER = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(title, content) of each section that a Markdown header opens; text before the first has an empty title."""
    at = list(_HEADER.finditer(text))
    out = [("", text[: at[0].start()] if at else text)]
    out += [(m[2], text[m.end() : n.start() if n else len(text)]) for m, n in zip(at, [*at[1:], None], strict=False)]
    return [(t, c.strip("\n")) for t, c in out if t or c.strip()]


def windows_of(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most so many characters that end after their last space, if they have one and are not the last; each begins overlap characters before the end of the one
    before (one character after its beginning at least). Blank pieces are left out."""
    return list(_windows(text, size, overlap))


def _windows(text: str, size: int, overlap: int) -> Iterator[str]:
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text) and (space := text.rfind(" ", start, end)) >= 0:
            end = space + 1
        if text[start:end].strip():
            yield text[start:end]
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)


def chunk_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 500, overlap: int = 50, markdown: bool = False, embed: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """doc_id, chunk_no (from 0), title, content and, with embed, embedding, of every chunk.

    Chunks are Markdown sections, cut further where they are longer than size, or simply pieces of a text (see windows_of). Each piece's beginning depends on
    the one before, so they are cut in Python, in Arrow batches of bounded bytes, and leave it by PART_BYTES characters. embed maps a pandas Series of contents to one of float lists, batch by batch.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    d = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def pieces(text):
        if not markdown:
            yield from (("", p) for p in _windows(text, size, overlap))
            return
        for title, body in markdown_sections(text):
            p = None
            for p in _windows(body, size, overlap):
                yield title, p
            if p is None:
                yield title, ""

    def run(batches):
        for b in batches:
            for part in parts(b):
                at, numbers, titles, contents, held = [], [], [], [], 0
                for i, t in enumerate(part.column(1)):
                    for k, (title, p) in enumerate(pieces(t.as_py() or "")):
                        at.append(i), numbers.append(k), titles.append(title), contents.append(p)
                        held += len(p)
                        if held >= PART_BYTES:
                            yield chunks(part, at, numbers, titles, contents)
                            at, numbers, titles, contents, held = [], [], [], [], 0
                if at:
                    yield chunks(part, at, numbers, titles, contents)

    def chunks(part, at, numbers, titles, contents):
        arrays = [part.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array(titles, pa.string()), pa.array(contents, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "chunk_no", "title", "content"])

    prepare(df.sparkSession)
    out = d.mapInArrow(lambda batches: trimmed(run(batches)), f"doc_id {df.schema[id_col].dataType.simpleString()}, chunk_no int, title string, content string")
    if embed is not None:
        out = out.withColumn("embedding", F.pandas_udf(embed, "array<float>")("content"))
    return out


def ingest_files(spark: SparkSession, path: str, target: str, *, size: int = 500, overlap: int = 50, markdown: bool = True, embed: Callable | None = None) -> int:
    """Chunks of text files appended to a Parquet table (path, chunk_no, title, content[, embedding]); how many."""
    docs = read_texts(spark, path)
    chunks = chunk_documents(docs, id_col="path", text_col="content", size=size, overlap=overlap, markdown=markdown, embed=embed).withColumnRenamed("doc_id", "path")
    before = spark.read.parquet(target).count() if _exists(spark, target) else 0
    chunks.write.mode("append").parquet(target)
    return spark.read.parquet(target).count() - before


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
