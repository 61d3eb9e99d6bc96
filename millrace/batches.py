"""What bounds a Python worker's memory: small Arrow batches, and few rows as Python objects at once."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once, and that it turns into objects at once.
BATCH_BYTES, PART_BYTES = 8 << 20, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Batches for Python are of BATCH_BYTES, unless the session says otherwise. Workers beside this driver find this package where the driver found it; elsewhere it is
    installed, or shipped with --py-files."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), root]))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the worker, which waits for its next task, gives back what memory it has free."""
    try:
        yield from batches
    finally:
        import ctypes

        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def parts(b: pa.RecordBatch | pa.Array, most: int | None = None) -> Iterator[pa.RecordBatch | pa.Array]:
    """The rows of a batch, or the values of an array, in runs of about so many bytes (PART_BYTES): a bound on what a worker holds as Python objects. Rows stay whole."""
    most = most or PART_BYTES
    rows = max(1, int(len(b) * most / max(b.nbytes, most)))
    for a in range(0, len(b), rows):
        yield b.slice(a, rows)
