"""Sessions and the folder that a job's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "4g", **conf: str) -> SparkSession:
    """A local session with the settings that the library's results rely on (UTC) and its plans profit from (AQE)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where it is unset, gets one of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def written(df: DataFrame, label: str, *, result: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: computed once, with no lineage, and readable after executors are lost.

    Within scratch() it goes at the scope's end, or with result at the end of the scope around that, if there is one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    scopes = _SCOPES.get()
    if len(scopes) > result:
        scopes[-1 - result].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose written() tables are removed at its end: for what no result reads any more."""
    paths: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            remove(spark, path)
