"""Tables that change: versions, constraints, upserts, transactions, TTL and materialised views over Parquet files.

A version of a table is a manifest: its columns, properties and the list of its data files. Files are never changed. An append adds files; an update,
delete or upsert finds the files that hold affected rows and rewrites only those. A commit writes the next manifest aside and renames it to its number, which
fails if somebody else has that number already: the first one wins, and readers always see a whole version. (The rename must not replace a file: so it is on
HDFS and local disks; an object store needs a committer that gives the same.) A transaction's manifests name it, and count from the moment its one commit record is there.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an engine allows: changes of rows, indexes, TTL, ALTER, keys.
CAPABILITIES = {
    "columnar": {"update", "delete", "upsert", "index", "vector_index", "ttl", "alter", "primary_key", "persistent"},
    "memory": {"update", "delete", "upsert", "primary_key"},
    "log": {"persistent"},
}


class TableError(ValueError):
    """A statement that a table's definition or state rejects."""


@dataclass
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    auto_increment: bool = False
    default: str | None = None
    logical: str | None = None
    physical: str = ""


@dataclass
class Manifest:
    columns: list[dict] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__)


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join by key, which is to be shuffled and sorted. Left alone, Spark takes the size of its files, where keys are packed to a fraction of their size in
    memory, for that of its rows, and sends millions of them through the driver to all executors."""
    return df.hint("merge")


class Files:
    """The few file operations that manifests need, through Hadoop's interface, so any store that Spark can write serves."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, path: str, text: str) -> None:
        """A whole file or none: written aside, then renamed. Fails if the name is taken."""
        fs, p = self._at(path)
        aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        _, q = self._at(aside)
        out = fs.create(q, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(q, p, none)
        except Exception:
            fs.delete(q, False)
            raise

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Catalog:
    """The tables under a root folder, with one open transaction at most."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), Files(spark)
        self._open: dict | None = None  # table: (version it is based on, manifest) of the transaction
        self._savepoints: list[tuple[str, dict]] = []
        self._known: dict[tuple[str, int], Manifest] = {}  # manifests that count; they never change

    # versions ---------------------------------------------------------------------------------------------------

    def _log(self, table: str) -> str:
        return f"{self.root}/{table.lower()}/_log"

    def _numbers(self, table: str) -> list[int]:
        return [int(n[:-5]) for n in self.fs.names(self._log(table)) if re.fullmatch(r"\d{12}\.json", n)]

    def versions(self, table: str) -> list[int]:
        """The versions that count: all but those of transactions without a commit record, which are the last ones if any."""
        v = self._numbers(table)
        while v and self._load(table, v[-1]) is None:
            v.pop()
        return [x for x in v if self._load(table, x) is not None] if any((table.lower(), x) not in self._known for x in v) else v

    def _load(self, table: str, version: int) -> Manifest | None:
        key = table.lower(), version
        if key not in self._known:
            m = Manifest(**json.loads(self.fs.read(f"{self._log(table)}/{version:012d}.json")))
            if (txn := m.props.get("txn")) and self._fate(txn) != "commit":
                return None
            self._known[key] = m
        return self._known[key]

    def _fate(self, txn: str) -> str | None:
        return self.fs.read(f"{self.root}/_transactions/{txn}") if txn in self.fs.names(f"{self.root}/_transactions") else None

    def tables(self) -> list[str]:
        names = {n for n in self.fs.names(self.root) if n != "_transactions" and self.versions(n) and not self._stored(n).props.get("dropped")}
        if self._open is not None:
            names = {n for n in names | set(self._open) if n not in self._open or not self._open[n][1].props.get("dropped")}
        return sorted(names)

    def _stored(self, table: str, version: int | None = None) -> Manifest:
        v = self.versions(table)
        if not v or version is not None and version not in v:
            raise TableError(f"no table {table}" + (f" at version {version}" if v else ""))
        return copy.deepcopy(self._load(table, v[-1] if version is None else version))

    def manifest(self, table: str, version: int | None = None) -> Manifest:
        t = table.lower()
        if version is None and self._open is not None and t in self._open:
            m = self._open[t][1]
        else:
            if version is None and self._open is not None and (pinned := self._pin(t)) is not None:
                version = pinned
            m = self._stored(t, version)
        if m.props.get("dropped"):
            raise TableError(f"no table {table}")
        return copy.deepcopy(m)

    def _pin(self, table: str) -> int | None:
        """In a transaction a table stays at the version at which it was first seen."""
        pins = self._pins
        if table not in pins and (v := self.versions(table)):
            pins[table] = v[-1]
        return pins.get(table)

    def _put(self, table: str, m: Manifest) -> None:
        t = table.lower()
        if self._open is not None:
            base = self._open[t][0] if t in self._open else self._pin(t) or 0
            self._open[t] = (base, m)
            m.props.pop("txn", None)
        else:
            m.props.pop("txn", None)
            v = self.versions(t)
            self._commit(t, (v[-1] if v else 0), m)

    def _commit(self, table: str, base: int, m: Manifest) -> None:
        """The next version after base. What a transaction that never ended has left in between is ended for it first, so that it cannot come in later."""
        taken = [v for v in self._numbers(table) if v > base]
        for v in taken:
            txn = json.loads(self.fs.read(f"{self._log(table)}/{v:012d}.json"))["props"].get("txn")
            if txn and self._fate(txn) is None and txn != m.props.get("txn"):
                try:
                    self.fs.create(f"{self.root}/_transactions/{txn}", "abort")
                except Exception:  # noqa: BLE001 - it has ended meanwhile, one way or the other
                    pass
        if (self.versions(table) or [0])[-1] != base:
            raise TableError(f"{table} was changed meanwhile; there is a version after {base}")
        number = max([base, *taken]) + 1
        try:
            self.fs.create(f"{self._log(table)}/{number:012d}.json", m.text())
        except Exception as e:  # noqa: BLE001 - the store says in its own way that the version exists
            if number in self._numbers(table):
                raise TableError(f"{table} was changed meanwhile; version {number} exists") from e
            raise

    @property
    def in_transaction(self) -> bool:
        return self._open is not None

    def begin(self) -> None:
        if self._open is not None:
            raise TableError("a transaction is open already")
        self._open, self._pins, self._savepoints = {}, {}, []
        for t in self.fs.names(self.root):  # one snapshot for all tables
            self._pin(t)

    def commit(self) -> None:
        self._in()
        changed, self._open = self._open, None
        if stale := [t for t, (base, _) in changed.items() if (self.versions(t) or [0])[-1] != base]:
            raise TableError(f"{stale[0]} was changed meanwhile; nothing is committed")
        if len(changed) == 1:
            return self._commit(*next((t, base, m) for t, (base, m) in changed.items()))
        txn = uuid.uuid4().hex
        for t, (base, m) in sorted(changed.items()):
            m.props["txn"] = txn
            self._commit(t, base, m)
        if changed:
            try:
                self.fs.create(f"{self.root}/_transactions/{txn}", "commit")
            except Exception as e:  # noqa: BLE001
                raise TableError("another commit has ended this transaction; nothing is committed") from e
        return None

    def rollback(self, savepoint: str | None = None) -> None:
        self._in()
        if savepoint is None:
            self._open = None
            return
        k = self._find(savepoint)
        self._open = copy.deepcopy(self._savepoints[k][1])
        del self._savepoints[k + 1 :]

    def savepoint(self, name: str) -> None:
        self._in()
        self._savepoints.append((name.lower(), copy.deepcopy(self._open)))

    def release(self, name: str) -> None:
        self._in()
        del self._savepoints[self._find(name) :]

    def _find(self, name: str) -> int:
        for k in range(len(self._savepoints) - 1, -1, -1):
            if self._savepoints[k][0] == name.lower():
                return k
        raise TableError(f"no savepoint {name}")

    def _in(self) -> None:
        if self._open is None:
            raise TableError("no transaction is open")

    # definition -------------------------------------------------------------------------------------------------

    def create(self, table: str, columns: list[ColumnDef], *, engine: str = "columnar", ttl: tuple[str, int] | None = None, if_not_exists: bool = False, foreign_keys: list[dict] | None = None) -> None:
        if engine not in CAPABILITIES:
            raise TableError(f"no engine {engine}")
        if table.lower() in self.tables():
            if if_not_exists:
                return
            raise TableError(f"table {table} exists already")
        if len({c.name.lower() for c in columns}) != len(columns):
            raise TableError("two columns have one name")
        if any(c.primary_key for c in columns) and "primary_key" not in CAPABILITIES[engine]:
            raise TableError(f"engine {engine} has no primary keys")
        for k, c in enumerate(columns):
            c.physical = c.physical or f"c{k}_{c.name.lower()}"
            if c.primary_key:
                c.nullable = False
        if ttl and ttl[0].lower() not in {c.name.lower() for c in columns}:
            raise TableError(f"no column {ttl[0]}")
        self._put(table, Manifest([c.__dict__ for c in columns], [], {"engine": engine, "ttl": ttl, "indexes": {}, "next_auto": 1, "next_column": len(columns), "foreign_keys": foreign_keys or []}))

    def create_as(self, table: str, df: DataFrame, **kw) -> None:
        self.create(table, [ColumnDef(f.name, f.dataType.simpleString(), logical=(f.metadata or {}).get("logical")) for f in df.schema], **kw)
        self.insert(table, df)

    def drop(self, table: str, if_exists: bool = False) -> None:
        if table.lower() not in self.tables():
            if if_exists:
                return
            raise TableError(f"no table {table}")
        m = self.manifest(table)
        m.props["dropped"], m.files = True, []
        self._put(table, m)

    def _can(self, table: str, what: str) -> Manifest:
        m = self.manifest(table)
        if what not in CAPABILITIES[m.props["engine"]]:
            raise TableError(f"engine {m.props['engine']} does not allow {what}")
        return m

    def columns(self, table: str, version: int | None = None) -> list[ColumnDef]:
        return [ColumnDef(**c) for c in self.manifest(table, version).columns]

    def add_column(self, table: str, column: ColumnDef) -> None:
        m = self._can(table, "alter")
        if column.name.lower() in {c["name"].lower() for c in m.columns}:
            raise TableError(f"column {column.name} exists already")
        if not column.nullable and column.default is None and m.files:
            raise TableError("a NOT NULL column needs a default where there are rows")
        column.physical = f"c{m.props['next_column']}_{column.name.lower()}"
        m.props["next_column"] += 1
        m.columns.append(column.__dict__)
        self._put(table, m)
        if column.default is not None and m.files:
            self.update(table, {column.name: column.default}, "true")

    def drop_column(self, table: str, name: str) -> None:
        m = self._can(table, "alter")
        kept = [c for c in m.columns if c["name"].lower() != name.lower()]
        if len(kept) in (0, len(m.columns)) or any(c["primary_key"] for c in m.columns if c not in kept):
            raise TableError(f"column {name} cannot be dropped")
        m.columns = kept
        self._put(table, m)

    def rename_column(self, table: str, old: str, new: str) -> None:
        m = self._can(table, "alter")
        if old.lower() not in {c["name"].lower() for c in m.columns} or new.lower() in {c["name"].lower() for c in m.columns}:
            raise TableError(f"column {old} cannot be called {new}")
        for c in m.columns:
            if c["name"].lower() == old.lower():
                c["name"] = new
        self._put(table, m)

    def rename(self, table: str, new: str) -> None:
        m = self._can(table, "alter")
        if new.lower() in self.tables():
            raise TableError(f"table {new} exists already")
        self._put(new, m)
        self.drop(table)

    def create_index(self, name: str, table: str, columns: list[str], *, unique: bool = False, include: list[str] | None = None, kind: str = "ordered", options: dict | None = None) -> None:
        """Kept as a declaration (a unique one is checked on insert); Parquet statistics and sorted files do an index's work."""
        m = self._can(table, "vector_index" if kind == "vector" else "index")
        names = {c["name"].lower() for c in m.columns}
        if name.lower() in m.props["indexes"] or any(c.lower() not in names for c in columns):
            raise TableError(f"index {name} cannot be made")
        if unique:
            self._unique(self.read(table), [columns], f"index {name}")
        m.props["indexes"][name.lower()] = {"columns": columns, "unique": unique, "include": include or [], "kind": kind, "options": options or {}}
        self._put(table, m)

    # reading ----------------------------------------------------------------------------------------------------

    def _frame(self, m: Manifest, files: list[str], with_file: bool = False) -> DataFrame:
        schema = T.StructType([T.StructField(c["physical"], T._parse_datatype_string(c["type"])) for c in m.columns])
        extra = [F.col("_metadata.file_path").alias("__file")] if with_file else []
        cols = [F.col(f"`{c['physical']}`").alias(c["name"], metadata={"logical": c["logical"]} if c["logical"] else {}) for c in m.columns]
        if not files:
            df = self.spark.createDataFrame([], schema).select(*cols)
            return df.withColumn("__file", F.lit("")) if with_file else df
        return self.spark.read.schema(schema).parquet(*files).select(*cols, *extra)

    def read(self, table: str, version: int | None = None, now: Column | None = None) -> DataFrame:
        """A version (the current one of the transaction or the store). Rows that have outlived the table's TTL are not seen."""
        m = self.manifest(table, version)
        df = self._frame(m, m.files)
        return df.where(self._alive(m, now)) if m.props.get("ttl") else df

    def _alive(self, m: Manifest, now: Column | None = None) -> Column:
        col, seconds = m.props["ttl"]
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        return F.col(f"`{col}`").isNull() | (F.col(f"`{col}`") >= now - F.make_dt_interval(secs=F.lit(float(seconds))))

    # changes ----------------------------------------------------------------------------------------------------

    def _write(self, table: str, m: Manifest, df: DataFrame) -> list[str]:
        """New data files with df's rows, as full paths."""
        at = f"{self.root}/{table.lower()}/data-{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{c['name']}`").cast(c["type"]).alias(c["physical"]) for c in m.columns]).write.option("compression", "zstd").parquet(at)
        return [f"{at}/{n}" for n in self.fs.names(at) if n.endswith(".parquet")]

    def _filled(self, table: str, m: Manifest, df: DataFrame) -> DataFrame:
        """df with all of the table's columns, by name: defaults, automatic numbers, vectors from text, time stamps for TTL."""
        have = {c.lower(): c for c in df.columns}
        if extra := [c for c in have if c not in {x["name"].lower() for x in m.columns}]:
            raise TableError(f"{table} has no column {extra[0]}")
        cols, auto = [], None
        for c in m.columns:
            name, got = c["name"], have.get(c["name"].lower())
            x = F.col(f"`{got}`") if got else F.expr(c["default"]) if c["default"] is not None else F.lit(None)
            if got and c["type"].startswith("array") and dict(df.dtypes)[got] == "string":
                x = F.from_json(x, c["type"])
            else:
                x = x.try_cast(c["type"]) if got and dict(df.dtypes)[got] == "string" and c["type"] != "string" else x.cast(c["type"])
            if m.props.get("ttl") and name.lower() == m.props["ttl"][0].lower():
                x = F.coalesce(x, F.current_timestamp().cast("timestamp_ntz"))
            auto = name if c["auto_increment"] else auto
            cols.append(x.alias(name))
        out = df.select(*cols)
        return self._numbered(m, out, auto) if auto else out

    def _numbered(self, m: Manifest, df: DataFrame, auto: str) -> DataFrame:
        """Automatic numbers where there is NULL or 0. Rows are numbered within their partition, after an offset from counts of the partitions before: no single task sorts them all."""
        kind = dict(df.dtypes)[auto]
        explicit = df.agg(F.max(auto)).first()[0]
        start = max(m.props["next_auto"], (explicit or 0) + 1)
        marked = self._stable(df.withColumn("__part", F.spark_partition_id()).withColumn("__new", F.col(auto).isNull() | (F.col(auto) == 0)).withColumn("__order", F.monotonically_increasing_id()))
        counts = sorted((r["__part"], r["n"]) for r in marked.where("__new").groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
        offsets, at = {}, start
        for p, n in counts:
            offsets[p], at = at, at + n
        m.props["next_auto"] = at
        if not offsets:
            return marked.select(*df.columns)
        base = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
        seq = F.row_number().over(Window.partitionBy("__part", "__new").orderBy("__order")) - 1
        return marked.withColumn(auto, F.when(F.col("__new"), (base[F.col("__part")] + seq).cast(kind)).otherwise(F.col(auto))).select(*df.columns)

    def _stable(self, df: DataFrame) -> DataFrame:
        from millrace.session import written

        return written(df, "insert")

    def _keys(self, m: Manifest) -> list[list[str]]:
        pk = [c["name"] for c in m.columns if c["primary_key"]]
        return ([pk] if pk else []) + [[c["name"]] for c in m.columns if c["unique"]] + [i["columns"] for i in m.props["indexes"].values() if i["unique"]]

    def _unique(self, df: DataFrame, keys: list[list[str]], what: str) -> None:
        for key in keys:
            present = df.where(F.forall(F.array(*[F.col(f"`{c}`").isNotNull() for c in key]), lambda x: x))
            if present.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
                raise TableError(f"{what}: ({', '.join(key)}) must be unique")

    def _check(self, table: str, m: Manifest, df: DataFrame, against: DataFrame | None) -> None:
        """Raises if df's rows break NOT NULL, a key among themselves, a key of the rows in against, or a foreign key."""
        needed = [c["name"] for c in m.columns if not c["nullable"]]
        if needed:
            bad = df.select([F.max(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in needed]).first()
            for c in needed:
                if bad[c]:
                    raise TableError(f"{table}.{c} must not be NULL")
        keys = self._keys(m)
        self._unique(df, keys, table)
        for key in keys if against is not None else []:
            if df.select(*key).join(_sorted(against.select(*key)), key, "left_semi").limit(1).count():
                raise TableError(f"{table}: ({', '.join(key)}) exists already")
        for fk in m.props.get("foreign_keys", []):
            if not fk.get("enforced"):
                continue
            there = self.read(fk["table"]).select(*[F.col(r).alias(c) for c, r in zip(fk["columns"], fk["references"], strict=True)])
            present = df.select(*fk["columns"]).dropna()
            if present.join(_sorted(there), fk["columns"], "left_anti").limit(1).count():
                raise TableError(f"{table}: ({', '.join(fk['columns'])}) is not in {fk['table']}")

    def insert(self, table: str, df: DataFrame) -> DataFrame:
        """Appends df's rows (matched by name, other columns get defaults), after checks; returns them as stored."""
        m = self.manifest(table)
        rows = self._filled(table, m, df)
        if self._keys(m) or any(not c["nullable"] for c in m.columns) or m.props.get("foreign_keys"):
            rows = self._stable(rows)
            self._check(table, m, rows, self._frame(m, m.files) if m.files else None)
        new = self._write(table, m, rows)
        m.files = m.files + new
        self._put(table, m)
        return self._frame(m, new)

    def upsert(self, table: str, df: DataFrame, *, key: list[str] | None = None, update: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
        """Inserts rows whose key is new. For others: nothing if update is None; else the old row with update's columns set. Returns the rows inserted and updated, as stored.

        update maps columns to SQL expressions over the old row's columns and excluded.c, the new row's. Of new rows that share a key the last in the
        order of a column of df counts (any one without order). A NULL in a key is never equal to another. NOT NULL, all keys and foreign keys hold for what is
        inserted and updated, against the rows that stay. Only files that hold matched keys are rewritten.
        """
        m = self._can(table, "upsert")
        key = key or next(iter(self._keys(m)), None)
        if not key:
            raise TableError(f"{table} has no key to conflict on")
        ranked = df
        if set(key) <= set(df.columns):
            w = Window.partitionBy(*[F.col(f"`{c}`") for c in key]).orderBy(F.desc(order) if order else F.lit(1))
            some_null = F.exists(F.array(*[F.col(f"`{c}`").isNull() for c in key]), lambda x: x)
            ranked = df.withColumn("__turn", F.row_number().over(w)).where((F.col("__turn") == 1) | some_null).drop("__turn")
            ranked = ranked.drop(order) if order and order.lower() not in {c["name"].lower() for c in m.columns} else ranked
        rows = self._stable(self._filled(table, m, ranked))
        files, names = list(m.files), [c["name"] for c in m.columns]
        if not files:
            return self._upserted(table, m, rows, None, None, files, [])
        old = self._frame(m, files, with_file=True)
        fresh = rows.join(_sorted(old.select(*key)), key, "left_anti").select(*names)
        if update is None:
            return self._upserted(table, m, fresh, None, old.drop("__file"), files, [])
        given = {c.lower(): c for c in update}
        e = rows.select(*[F.col(f"`{c}`").alias(f"excluded__{c}") for c in names])
        on = [F.col(f"o.`{c}`") == F.col(f"excluded__{c}") for c in key]
        values = {c["name"]: F.expr(re.sub(r"\bexcluded\s*\.\s*`?(\w+)`?", r"excluded__\1", update[given[c["name"].lower()]], flags=re.I)).cast(c["type"]) for c in m.columns if c["name"].lower() in given}
        changed = old.alias("o").join(_sorted(e), on).select(*[values[c].alias(c) if c in values else F.col(f"o.`{c}`") for c in names], F.col("__file"))
        changed = self._stable(changed)
        touched = [r[0] for r in changed.select("__file").distinct().collect()]  # files, not rows
        rest = old.join(_sorted(rows.select(*key)), key, "left_anti").select(*names, "__file")
        return self._upserted(table, m, fresh, changed.select(*names), rest, files, touched)

    def _upserted(self, table: str, m: Manifest, fresh: DataFrame, changed: DataFrame | None, rest: DataFrame | None, files: list[str], touched: list[str]) -> DataFrame:
        """Stores an upsert's rows: fresh ones, changed ones (with what stays of the touched files). rest: all rows that stay."""
        names = [c["name"] for c in m.columns]
        new = fresh if changed is None else fresh.unionByName(changed)
        self._check(table, m, new, rest.select(*names) if rest is not None else None)
        added = self._write(table, m, new)
        if touched:
            kept = self._frame(m, touched, with_file=True)
            stay = rest.where(F.col("__file").isin(touched)) if len(touched) <= 1000 else rest.join(kept.select("__file").distinct(), "__file", "left_semi")
            files = self._without(files, touched) + self._write(table, m, stay.select(*names))
        m.files = files + added
        self._put(table, m)
        return self._frame(m, added)

    def _without(self, files: list[str], gone: list[str]) -> list[str]:
        names = {g.rpartition("/data-")[2] for g in gone}
        return [f for f in files if f.rpartition("/data-")[2] not in names]

    def update(self, table: str, values: dict[str, str], where: str = "true") -> int:
        """Sets columns to SQL expressions over the old row where the condition holds; how many rows."""
        m = self._can(table, "update")
        if unknown := [c for c in values if c.lower() not in {x["name"].lower() for x in m.columns}]:
            raise TableError(f"{table} has no column {unknown[0]}")
        old = self._frame(m, m.files, with_file=True)
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched = old.where(hit).groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
        if not touched:
            return 0
        files = [r["__file"] for r in touched]
        given = {c.lower(): v for c, v in values.items()}
        new = self._frame(m, files).select(*[F.when(hit, F.expr(given[c["name"].lower()]).cast(c["type"])).otherwise(F.col(f"`{c['name']}`")).alias(c["name"]) if c["name"].lower() in given else F.col(f"`{c['name']}`") for c in m.columns])
        keep = self._without(m.files, files)
        if any(c["name"].lower() in given for c in m.columns if not c["nullable"] or any(c["name"] in k for k in self._keys(m))):
            new = self._stable(new)
            self._check(table, m, new, self._frame(m, keep) if keep else None)
        m.files = keep + self._write(table, m, new)
        self._put(table, m)
        return sum(r["n"] for r in touched)

    def delete(self, table: str, where: str = "true") -> int:
        m = self._can(table, "delete")
        old = self._frame(m, m.files, with_file=True)
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched = old.where(hit).groupBy("__file").agg(F.count(F.lit(1)).alias("n")).collect()
        if touched:
            files = [r["__file"] for r in touched]
            m.files = self._without(m.files, files) + self._write(table, m, self._frame(m, files).where(~hit))
            self._put(table, m)
        return sum(r["n"] for r in touched)

    def replace(self, table: str, df: DataFrame) -> None:
        """df's rows instead of the table's, without checks of keys."""
        m = self.manifest(table)
        m.files = self._write(table, m, self._filled(table, m, df))
        self._put(table, m)

    def truncate(self, table: str) -> None:
        m = self.manifest(table)
        m.files, m.props["next_auto"] = [], 1
        self._put(table, m)

    def compact(self, table: str, now: Column | None = None, sort_by: list[str] | None = None, small_bytes: int | None = None) -> None:
        """Live rows in new files, range-partitioned by a cluster key if there is one; rows past their TTL go for good. With small_bytes only files under that size are
        put together (if there are two or more); the others stay as they are."""
        m = self.manifest(table)
        files = m.files if small_bytes is None else [f for f in m.files if self.fs.size(f) < small_bytes]
        if small_bytes is not None and len(files) < 2:
            return
        df = self._frame(m, files)
        if m.props.get("ttl"):
            df = df.where(self._alive(m, now))
        if sort_by:
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        elif small_bytes is not None:
            df = df.coalesce(max(1, sum(map(self.fs.size, files)) // max(small_bytes, 1)))
        m.files = (self._without(m.files, files) if files else m.files) + self._write(table, m, df)
        self._put(table, m)

    def vacuum(self, table: str, keep: int = 1) -> int:
        """Removes data that no version among the last keep ones names (of rewrites, drops, rollbacks and failed writes), and older versions; how many folders. Not while others write."""
        v = self.versions(table)
        kept = [self._load(table, x) for x in v[-keep:]]
        used = {f.rpartition("/data-")[2].partition("/")[0] for m in kept for f in m.files}
        gone = [n for n in self.fs.names(f"{self.root}/{table.lower()}") if n.startswith("data-") and n.removeprefix("data-") not in used]
        for x in v[:-keep]:
            self.fs.delete(f"{self._log(table)}/{x:012d}.json")
            self._known.pop((table.lower(), x), None)
        for n in gone:
            self.fs.delete(f"{self.root}/{table.lower()}/{n}")
        return len(gone)

    # views and information ---------------------------------------------------------------------------------------

    def create_view(self, name: str, sql: str, df: DataFrame) -> None:
        self.create_as(name, df)
        m = self.manifest(name)
        m.props["view"] = sql
        self._put(name, m)

    def refresh_view(self, name: str, df: DataFrame) -> None:
        m = self.manifest(name)
        if "view" not in m.props:
            raise TableError(f"{name} is no materialised view")
        m.files = self._write(name, m, df)
        self._put(name, m)

    def pragma(self, what: str, arg: str | None = None) -> DataFrame:
        mk = self.spark.createDataFrame
        if what == "table_info":
            rows = [(k, c.name, c.type, not c.nullable, c.default, c.primary_key) for k, c in enumerate(self.columns(arg or ""))]
            return mk(rows, "cid int, name string, type string, notnull boolean, dflt_value string, pk boolean")
        if what in ("columns", "information_schema_columns"):
            rows = [(t, c.name, k, c.type, c.nullable, c.primary_key, c.auto_increment) for t in ([arg] if arg else self.tables()) for k, c in enumerate(self.columns(t))]
            return mk(rows, "table_name string, column_name string, ordinal_position int, data_type string, nullable boolean, is_primary_key boolean, auto_increment boolean")
        if what in ("tables", "information_schema_tables"):
            rows = [(t, "BASE TABLE", self.read(t).count(), len(m.columns), ", ".join(c["name"] for c in m.columns if c["primary_key"]) or None, bool(m.props.get("ttl")), m.props["engine"]) for t in self.tables() for m in [self.manifest(t)]]
            return mk(rows, "table_name string, table_type string, row_count bigint, column_count int, primary_key string, has_ttl boolean, engine string")
        if what == "database_list":
            return mk([(0, "main", self.root)], "seq int, name string, file string")
        if what in ("indexes", "index_list", "information_schema_indexes"):
            rows = [(t, n, i["kind"], ", ".join(i["columns"]), ", ".join(i["include"]), i["unique"]) for t in ([arg] if arg else self.tables()) for n, i in self.manifest(t).props["indexes"].items()]
            return mk(rows, "table_name string, index_name string, index_type string, key_columns string, included_columns string, unique boolean")
        if what == "index_info":
            rows = [(k, c, n) for t in self.tables() for n, i in self.manifest(t).props["indexes"].items() if (arg or "").lower() in (n, t) for k, c in enumerate(i["columns"])]
            return mk(rows, "seqno int, name string, index_name string")
        if what == "page_count":
            return mk([(sum(len(self.manifest(t).files) for t in self.tables()),)], "page_count int")
        fixed = {"journal_mode": "manifest", "synchronous": "full", "cache_size": "0", "page_size": "0"}
        if what in fixed:
            return mk([(fixed[what],)], f"{what} string")
        raise TableError(f"no pragma {what}")
