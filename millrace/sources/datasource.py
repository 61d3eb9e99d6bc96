"""Versioned tables as a Spark data source: spark.read.format("millrace").option("root", …).option("table", …).load()."""

from __future__ import annotations

import json
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def current(root: str, table: str, version: int | None = None) -> dict:
    """The manifest of a table's version, the last that counts if none is given, read without a session."""
    from pyarrow import fs

    store, base = _store(root)

    def text(path: str) -> str:
        with store.open_input_stream(path) as f:
            return f.read().decode()

    log = store.get_file_info(fs.FileSelector(f"{base}/{table.lower()}/_log"))
    for n in sorted((int(i.base_name[:-5]) for i in log if re.fullmatch(r"\d{12}\.json", i.base_name)), reverse=True):
        if version is not None and n != version:
            continue
        m = json.loads(text(f"{base}/{table.lower()}/_log/{n:012d}.json"))
        if txn := m["props"].get("txn"):
            record = f"{base}/_transactions/{txn}"
            if store.get_file_info(record).type == fs.FileType.NotFound or text(record) != "commit":
                continue
        if m["props"].get("dropped"):
            break
        return m
    raise ValueError(f"no table {table}")


class _File(InputPartition):
    pass


class TableSource(DataSource):
    """Options: root, table and, for an older one, version. Rows past a TTL are not hidden here."""

    @classmethod
    def name(cls) -> str:
        return "millrace"

    def _manifest(self) -> dict:
        v = self.options.get("version")
        return current(self.options["root"], self.options["table"], int(v) if v else None)

    def schema(self) -> StructType:
        kinds = {"bigint": "long"}
        return StructType([StructField(c["name"], _type(kinds.get(c["type"], c["type"]))) for c in self._manifest()["columns"]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._manifest())


def _type(text: str):
    from pyspark.sql import types as T

    simple = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType())}
    return simple[text] if text in simple else _parse_datatype_string(text)


class _Reader(DataSourceReader):
    def __init__(self, manifest: dict):
        self.files, self.columns = manifest["files"], manifest["columns"]

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition):
        """A data file's row groups as Arrow batches, columns by their physical names; a column that the file does not have yet is NULL."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        if partition is None or partition.value is None:
            return
        store, path = _store(partition.value)
        with store.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            have = set(file.schema_arrow.names)
            for b in file.iter_batches(columns=[c["physical"] for c in self.columns if c["physical"] in have]):
                by = dict(zip(b.schema.names, b.columns, strict=True))
                yield pa.RecordBatch.from_arrays([by.get(c["physical"], pa.nulls(b.num_rows)) for c in self.columns], names=[c["name"] for c in self.columns])
