import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import Engine
from millrace.operators.tables import Catalog, ColumnDef, TableError


@pytest.fixture
def eng(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_select(eng):
    eng.execute("CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR, age INT)")
    eng.execute("INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob', 25), (3, 'Charlie', 35)")
    assert rows(eng.execute("SELECT name FROM users WHERE age > 26")) == [("Alice",), ("Charlie",)]
    assert rows(eng.execute("SELECT LEN(name) AS n, MOD(age, 7) AS m FROM users WHERE id = ?", [2])) == [(3, 4)]
    assert rows(eng.execute("SELECT id FROM users WHERE name = $1 OR name = $1", ["Bob"])) == [(2,)]


def test_upsert(eng):
    eng.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, score INT)")
    eng.execute("INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2)")
    eng.execute("INSERT INTO t VALUES (1, 'x', 10), (3, 'c', 3) ON CONFLICT (id) DO UPDATE SET score = score + excluded.score")
    assert rows(eng.execute("SELECT * FROM t")) == [(1, "a", 11), (2, "b", 2), (3, "c", 3)]
    eng.execute("INSERT INTO t VALUES (1, 'y', 0), (4, 'd', 4) ON CONFLICT DO NOTHING")
    eng.execute("INSERT OR IGNORE INTO t VALUES (2, 'z', 0)")
    eng.execute("REPLACE INTO t VALUES (3, 'first', 0), (3, 'last', 9)")
    assert rows(eng.execute("SELECT * FROM t")) == [(1, "a", 11), (2, "b", 2), (3, "last", 9), (4, "d", 4)]
    with pytest.raises(TableError):
        eng.execute("INSERT INTO t VALUES (1, 'again', 1)")


def test_update_delete_truncate(eng):
    eng.execute("CREATE TABLE t (id INT, v INT)")
    eng.execute("INSERT INTO t VALUES (1, 1), (2, NULL), (3, 3)")
    assert eng.execute("UPDATE t SET v = v * 2 + id WHERE v > 0").first()[0] == 2
    assert rows(eng.execute("SELECT * FROM t")) == [(1, 3), (2, None), (3, 9)]
    assert eng.execute("DELETE FROM t WHERE v > 5").first()[0] == 1  # a NULL condition keeps its row
    assert rows(eng.execute("SELECT id FROM t")) == [(1,), (2,)]
    eng.execute("TRUNCATE TABLE t")
    assert eng.execute("SELECT * FROM t").count() == 0


def test_constraints(eng):
    eng.execute("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, a INT NOT NULL, b INT DEFAULT 7)")
    assert rows(eng.execute("INSERT INTO t (a) VALUES (1), (2) RETURNING id, b")) == [(1, 7), (2, 7)]
    eng.execute("INSERT INTO t (id, a) VALUES (10, 3)")
    eng.execute("INSERT INTO t (id, a) VALUES (0, 4)")
    assert rows(eng.execute("SELECT id FROM t")) == [(1,), (10,), (11,), (2,)]
    with pytest.raises(TableError):
        eng.execute("INSERT INTO t (a) VALUES (NULL)")
    with pytest.raises(TableError):
        eng.execute("INSERT INTO t (id, a) VALUES (20, 1), (20, 2)")
    eng.execute("CREATE TABLE u (k INT, v INT)")
    eng.execute("INSERT INTO u VALUES (1, 1), (1, 2), (NULL, 1)")
    with pytest.raises(TableError):
        eng.execute("CREATE UNIQUE INDEX ux ON u (k)")
    eng.execute("CREATE UNIQUE INDEX uv ON u (k, v) INCLUDE (v)")
    with pytest.raises(TableError):
        eng.execute("INSERT INTO u VALUES (1, 2)")
    eng.execute("INSERT INTO u VALUES (NULL, 1)")  # NULLs are never equal


def test_transactions(eng):
    eng.execute("CREATE TABLE t (id INT)")
    eng.execute("INSERT INTO t VALUES (1)")
    eng.execute("BEGIN")
    eng.execute("INSERT INTO t VALUES (2)")
    eng.execute("SAVEPOINT s")
    eng.execute("DELETE FROM t")
    assert eng.execute("SELECT * FROM t").count() == 0
    other = Catalog(eng.spark, eng.catalog.root)
    assert other.read("t").count() == 1  # nothing is seen before the commit
    eng.execute("ROLLBACK TO SAVEPOINT s")
    eng.execute("RELEASE SAVEPOINT s")
    eng.execute("COMMIT")
    assert rows(other.read("t")) == [(1,), (2,)]
    eng.execute("BEGIN")
    eng.execute("TRUNCATE TABLE t")
    eng.execute("ROLLBACK")
    assert eng.execute("SELECT * FROM t").count() == 2


def test_first_committer_wins(eng):
    eng.execute("CREATE TABLE t (id INT)")
    eng.execute("BEGIN")
    eng.execute("INSERT INTO t VALUES (1)")
    other = Catalog(eng.spark, eng.catalog.root)
    other.insert("t", eng.spark.createDataFrame([(9,)], "id bigint"))
    with pytest.raises(TableError):
        eng.execute("COMMIT")
    assert rows(other.read("t")) == [(9,)]


def test_versions_and_schema_changes(eng):
    c = eng.catalog
    eng.execute("CREATE TABLE t (id INT, v VARCHAR)")
    eng.execute("INSERT INTO t VALUES (1, 'a')")
    v = c.versions("t")[-1]
    eng.execute("ALTER TABLE t ADD COLUMN w INT DEFAULT 5")
    eng.execute("ALTER TABLE t RENAME COLUMN v TO name")
    eng.execute("ALTER TABLE t DROP COLUMN id")
    eng.execute("ALTER TABLE t ADD COLUMN id INT")
    assert rows(eng.execute("SELECT name, w, id FROM t")) == [("a", 5, None)]
    assert rows(c.read("t", version=v)) == [(1, "a")]
    eng.execute("ALTER TABLE t RENAME TO u")
    assert c.tables() == ["u"]
    eng.execute("DROP TABLE u")
    with pytest.raises(TableError):
        eng.execute("PRAGMA table_info(u)")
    eng.execute("DROP TABLE IF EXISTS u")


def test_ttl_and_engines(eng):
    c, now = eng.catalog, F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    c.create("t", [ColumnDef("id", "bigint"), ColumnDef("at", "timestamp_ntz")], ttl=("at", 60))
    c.insert("t", eng.spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 59, 30)), (2, dt.datetime(2024, 1, 1, 0, 58))], "id bigint, at timestamp_ntz"))
    assert [r[0] for r in c.read("t", now=now).collect()] == [1]
    c.compact("t", now=now, sort_by=["id"])
    assert c.read("t", now=F.lit("2000-01-01").cast("timestamp_ntz")).count() == 1
    eng.execute("CREATE TABLE log (ts INT, event TEXT) ENGINE = Log")
    eng.execute("INSERT INTO log VALUES (1, 'a')")
    for bad in ("DELETE FROM log", "UPDATE log SET ts = 2", "CREATE TABLE l2 (id INT PRIMARY KEY) ENGINE=Log"):
        with pytest.raises(TableError):
            eng.execute(bad)


def test_views_pragma_explain(eng):
    eng.execute("CREATE TABLE t (id INT PRIMARY KEY, v VECTOR(2), j JSON)")
    eng.execute("INSERT INTO t VALUES (1, '[1, 0]', '{\"k\": 1}'), (2, '[0, 1]', NULL)")
    eng.execute("CREATE VECTOR INDEX ix ON t (v) WITH (metric = cosine)")
    assert [r[0] for r in eng.execute("SELECT row_id FROM vector_search(t, ix, '[0.1, 1]', 1)").collect()] == [2]
    assert eng.execute("PRAGMA index_list(t)").first()["index_type"] == "vector"
    assert rows(eng.execute("PRAGMA table_info(t)").select("name", "type"))[0] == ("id", "bigint")
    assert rows(eng.execute("SELECT JSON_SET(j, '$.z', '2') AS a, JSON_OBJECT('id', id, 'x', 'y') AS b FROM t WHERE id = 1")) == [('{"k":1,"z":2}', '{"id":1,"x":"y"}')]
    eng.execute("CREATE MATERIALIZED VIEW mv AS SELECT count(*) AS n FROM t")
    eng.execute("DELETE FROM t WHERE id = 1")
    assert eng.execute("SELECT n FROM mv").first()[0] == 2
    eng.execute("REFRESH MATERIALIZED VIEW mv")
    assert eng.execute("SELECT n FROM mv").first()[0] == 1
    plan = [r[0] for r in eng.execute("EXPLAIN ANALYZE SELECT * FROM t").collect()]
    assert "rows: 1" in plan and eng.execute("ANALYZE t").count() == 3


def test_upsert_keeps_constraints_and_reports(eng):
    eng.execute("CREATE TABLE t (id INT PRIMARY KEY, email VARCHAR UNIQUE, n INT NOT NULL)")
    eng.execute("INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 2)")
    for bad in (
        "INSERT INTO t VALUES (3, 'a', 2) ON CONFLICT (id) DO UPDATE SET n = excluded.n", "INSERT INTO t VALUES (2, 'a', 2) ON CONFLICT (id) DO UPDATE SET email = excluded.email",
        "INSERT INTO t VALUES (2, 'x', 2) ON CONFLICT (id) DO UPDATE SET n = NULL", "INSERT INTO t VALUES (3, 'c', NULL) ON CONFLICT (id) DO NOTHING", "INSERT INTO t VALUES (3, 'b', 1) ON CONFLICT (id) DO NOTHING",
    ):
        with pytest.raises(TableError):
            eng.execute(bad)
    assert rows(eng.execute("SELECT * FROM t")) == [(1, "a", 1), (2, "b", 2)]
    assert rows(eng.execute("INSERT INTO t VALUES (2, 'b', 5), (3, 'c', 3) ON CONFLICT (id) DO UPDATE SET n = n + excluded.n RETURNING id, n")) == [(2, 7), (3, 3)]
    assert eng.execute("REPLACE INTO t VALUES (1, 'z', 9)").first()[0] == 1 and eng.execute("INSERT OR IGNORE INTO t VALUES (1, 'q', 0), (4, 'd', 4)").first()[0] == 1
    assert rows(eng.execute("SELECT * FROM t")) == [(1, "z", 9), (2, "b", 7), (3, "c", 3), (4, "d", 4)]


def test_update_with_sub_select(eng):
    eng.execute("CREATE TABLE t (id INT, n INT)")
    eng.execute("CREATE TABLE u (k INT, v INT)")
    eng.execute("INSERT INTO t VALUES (1, 0), (2, 0)")
    eng.execute("INSERT INTO u VALUES (1, 5), (2, 8)")
    assert eng.execute("UPDATE t SET n = (SELECT max(v) FROM u WHERE k > 1) WHERE id = 2").first()[0] == 1
    assert rows(eng.execute("SELECT * FROM t")) == [(1, 0), (2, 8)]


def test_arithmetic_by_type(eng):
    one = lambda x: eng.execute(f"SELECT {x} AS x").first()[0]
    assert [one(x) for x in ("7 / 2", "-7 / 2", "1 / 0", "1 % 0", "9223372036854775807 + 1", "9223372036854775807 * 2", "-9223372036854775807 - 9", "2147483647 + 1")] == [3, -3, None, None, None, None, None, 2147483648]
    assert [one(x) for x in ("7 / 2.0", "7.5 - 2", "1 + 2 * 3 - 8 / 3", "(1 + 2) * 3", "CASE WHEN 5 / 2 = 2 THEN 9 / 2 ELSE 0 END / 2", "2 - -3", "10 - 3 - 2", "100 / 7 / 2")] == [3.5, 5.5, 5, 9, 2, 5, 5, 7]
    assert [one(x) for x in ("CAST('abc' AS INT)", "CAST('12' AS INT) + 1", "TYPEOF(1 + 1)", "TYPEOF('a')", "TYPEOF(NULL)", "TYPEOF(1.5)")] == [None, 13, "int64", "varchar", "null", "float64"]
    assert str(one("STRPTIME('%Y-%m-%dT%H:%M:%S', '2024-05-06T07:08:09')")) == "2024-05-06 07:08:09" and one("1.0 / 0") != one("1.0 / 0")
    eng.execute("CREATE TABLE t (a INT, b INT, c DOUBLE)")
    eng.execute("INSERT INTO t VALUES (7, 2, 1.5), (9, 0, 2.5), (NULL, 1, 3.5)")
    assert rows(eng.execute("SELECT a / b AS q, a / c AS f, a + b AS s FROM t WHERE a / 2 > 2 ORDER BY a")) == [(3, 7 / 1.5, 9), (None, 9 / 2.5, 9)]
    assert rows(eng.execute("SELECT a / 4 AS g, SUM(b) AS s, COUNT(*) / 2 AS h FROM t GROUP BY a / 4")) == [(1, 2.0, 0), (2, 0.0, 0), (None, 1.0, 0)]
    assert rows(eng.execute("WITH x AS (SELECT a / 2 AS h FROM t) SELECT h / 2 AS k FROM x WHERE h IN (SELECT b + 1 FROM t)")) == [(1,)]
    eng.execute("UPDATE t SET a = a / b WHERE a / 2 = 3")
    assert rows(eng.execute("SELECT a FROM t")) == [(3,), (9,), (None,)]
    assert dict(eng.execute("SELECT SUM(a) AS s, SUM(DISTINCT b) AS d FROM t").dtypes) == {"s": "double", "d": "double"}


def test_commit_of_several_tables_is_one(eng):
    for t in ("a", "b"):
        eng.execute(f"CREATE TABLE {t} (id INT)")
    c = eng.catalog
    create, seen = c.fs.create, []

    def broken(path, text):
        if "_transactions" in path:
            seen.append(path)
            raise OSError("the driver died")
        return create(path, text)

    eng.execute("BEGIN")
    eng.execute("INSERT INTO a VALUES (1)")
    eng.execute("INSERT INTO b VALUES (1)")
    c.fs.create = broken
    with pytest.raises(TableError):
        eng.execute("COMMIT")
    c.fs.create = create
    other = Engine(eng.spark, c.root)
    assert seen and rows(other.execute("SELECT * FROM a")) == rows(other.execute("SELECT * FROM b")) == []
    other.execute("INSERT INTO a VALUES (2)")
    assert rows(other.execute("SELECT * FROM a")) == [(2,)] and rows(other.execute("SELECT * FROM b")) == []
    other.execute("BEGIN")
    other.execute("INSERT INTO a VALUES (3)")
    other.execute("INSERT INTO b VALUES (3)")
    other.execute("COMMIT")
    again = Engine(eng.spark, c.root)
    assert rows(again.execute("SELECT * FROM a")) == [(2,), (3,)] and rows(again.execute("SELECT * FROM b")) == [(3,)]


def test_batches_vacuum_and_foreign_keys(eng):
    eng = Engine(eng.spark, eng.catalog.root, batch_rows=100)
    eng.execute("CREATE TABLE t (id INT, v VARCHAR)")
    before = len(eng.catalog.versions("t"))
    for i in range(30):
        assert eng.execute(f"INSERT INTO t VALUES ({i}, 'x')").first()[0] == 1
    assert len(eng.catalog.versions("t")) == before and eng.execute("SELECT count(*) AS n FROM t").first()[0] == 30 and len(eng.catalog.versions("t")) == before + 1
    eng.execute("DELETE FROM t WHERE id < 10")
    eng.execute("UPDATE t SET v = 'y'")
    assert eng.catalog.vacuum("t") >= 2 and eng.execute("SELECT * FROM t").count() == 20 and eng.catalog.vacuum("t") == 0
    eng.execute("CREATE TABLE p (id INT PRIMARY KEY)")
    eng.execute("CREATE TABLE c (pid INT, FOREIGN KEY (pid) REFERENCES p (id) ENFORCED)")
    eng.execute("CREATE TABLE d (pid INT, FOREIGN KEY (pid) REFERENCES p (id))")
    eng.execute("INSERT INTO p VALUES (1)")
    eng.execute("INSERT INTO c VALUES (1), (NULL)")
    eng.execute("INSERT INTO d VALUES (2)")
    with pytest.raises(TableError):
        eng.execute("INSERT INTO c VALUES (2)")
    assert eng.execute("PRAGMA information_schema_tables").count() == 4


def test_small_files_are_put_together(eng):
    eng.execute("CREATE TABLE t (id INT)")
    eng.catalog.insert("t", eng.spark.range(200_000).coalesce(1))
    large = set(eng.catalog.manifest("t").files)
    for i in range(5):
        eng.execute(f"INSERT INTO t VALUES ({-i})")
    eng.catalog.compact("t", small_bytes=50_000)
    files = set(eng.catalog.manifest("t").files)
    assert large < files and len(files) == len(large) + 1 and eng.execute("SELECT * FROM t").count() == 200_005


def test_command_line(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "millrace", "SELECT 7 / 2 AS x"], capture_output=True, text=True, cwd=root, timeout=120)
    assert out.returncode == 0 and "3" in out.stdout and "3.5" not in out.stdout, out.stderr[-500:]


def test_rewritten_texts_are_remembered_by_types(eng, monkeypatch):
    from millrace.operators import engine

    calls = []
    monkeypatch.setattr(engine, "checked", lambda spark, text, plain=engine.checked: calls.append(text) or plain(spark, text))
    eng.execute("CREATE TABLE t (a INT)")
    eng.execute("INSERT INTO t VALUES (7)")
    for _ in range(3):
        assert rows(eng.execute("SELECT a / 2 AS h FROM t")) == [(3,)]
    assert len(calls) == 1
    eng.execute("DROP TABLE t")
    eng.execute("CREATE TABLE t (a DOUBLE)")
    eng.execute("INSERT INTO t VALUES (7)")
    assert rows(eng.execute("SELECT a / 2 AS h FROM t")) == [(3.5,)] and len(calls) == 2
    for kind, want in (("int", 3), ("double", 3.5)):
        eng.register("millrace_v", eng.spark.createDataFrame([(7,)], "a int").selectExpr(f"CAST(a AS {kind}) AS a"))
        assert rows(eng.execute("SELECT a / 2 AS h FROM millrace_v")) == [(want,)]
        eng.spark.createDataFrame([(7,)], "a int").selectExpr(f"CAST(a AS {kind}) AS a").createOrReplaceTempView("millrace_unknown")
        assert rows(eng.execute("SELECT a / 2 AS h FROM millrace_unknown")) == [(want,)]


@pytest.fixture
def no_broadcast(spark):
    """Any table that a join would send through the driver to all executors is an error."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_replace_sends_no_rows_through_the_driver(eng, no_broadcast):
    eng.execute("CREATE TABLE t (k INT PRIMARY KEY, v INT)")
    eng.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    eng.execute("INSERT OR IGNORE INTO t VALUES (1, 5), (3, 3)")
    eng.execute("REPLACE INTO t VALUES (2, 7), (4, 4)")
    assert rows(eng.execute("SELECT * FROM t")) == [(1, 1), (2, 7), (3, 3), (4, 4)]


def test_upsert_returns_rows_without_the_driver(eng, no_broadcast):
    eng.execute("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR)")
    eng.execute("INSERT INTO t VALUES (1, ''), (2, '')")
    got = eng.execute("INSERT INTO t VALUES (2, 'new'), (3, 'new') ON CONFLICT (k) DO UPDATE SET v = 'old' RETURNING k, v")
    assert rows(got) == [(2, "old"), (3, "new")]


def test_upsert_of_nothing_sends_no_rows_through_the_driver(eng, no_broadcast):
    eng.execute("CREATE TABLE t (k INT PRIMARY KEY, v INT)")
    eng.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    eng.execute("INSERT INTO t VALUES (2, 9), (3, 3) ON CONFLICT DO NOTHING")
    assert rows(eng.execute("SELECT * FROM t")) == [(1, 1), (2, 2), (3, 3)]


def test_upsert_update_and_foreign_key_send_no_rows_through_the_driver(eng, no_broadcast):
    eng.execute("CREATE TABLE c (c INT PRIMARY KEY)")
    eng.execute("INSERT INTO c VALUES (1), (2)")
    eng.execute("CREATE TABLE t (k INT PRIMARY KEY, c INT, v INT, FOREIGN KEY (c) REFERENCES c (c) ENFORCED)")
    eng.execute("INSERT INTO t VALUES (1, 1, 1), (2, 2, 2)")
    eng.execute("INSERT INTO t VALUES (2, 1, 5), (3, 2, 3) ON CONFLICT (k) DO UPDATE SET v = v + excluded.v")
    assert rows(eng.execute("SELECT * FROM t")) == [(1, 1, 1), (2, 2, 7), (3, 2, 3)]
    with pytest.raises(TableError):
        eng.execute("INSERT INTO t VALUES (4, 9, 1)")


def test_import_of_columns_that_stay_on_the_executors(eng, spark, monkeypatch):
    """Columns of a DataFrame are not gathered in the driver, in the query either; those of a caller are taken as before."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from millrace.plans import registry

    eng.execute("CREATE TABLE t (k INT, v VARCHAR)")
    assert eng.import_columns("t", {"k": [1, 2], "v": pa.array(["a", None])}) == 2
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("all rows are sent to the driver"))
    assert eng.import_columns("t", spark.createDataFrame([("c", 3)], "v string, k int")) == 1
    assert rows(eng.execute("SELECT * FROM t")) == [(1, "a"), (2, None), (3, "c")]
    got = registry.queries()["S23_import_columns"](spark, "/root/testdata/sf0.001")
    assert rows(got) == rows(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderpriority"))
