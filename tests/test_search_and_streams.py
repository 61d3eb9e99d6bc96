import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational, search
from millrace.sources import readers
from millrace.streaming import logs


def test_edit_distance_is_the_standard_one():
    assert search.edit_distance(["x"], ["x", "x"]) == 1 and search.edit_distance([], list("ab")) == 2
    assert search.edit_distance(list("kitten"), list("sitting")) == 3
    assert search.edit_similarity(["a", "b"], ["a", "b"]) == 1.0


def test_bm25_and_fuzzy(spark):
    d = spark.createDataFrame([(1, "the quick fox"), (2, "the lazy dog the end"), (3, None), (4, "")], "doc_id int, text string")
    got = search.bm25(d, "quick the").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score > got[1].score
    assert [r.doc_id for r in search.search_tokens(d, "the fox", mode="and").collect()] == [1]
    assert search.bm25(d, "").count() == 0
    assert search.fuzzy_edit(d, "the quick fox", 1).first()["similarity"] == 1.0
    assert [r.doc_id for r in search.fuzzy_ngram(d, "the quick", 5).collect()] == [1]


def test_rrf(spark):
    lists = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "doc_id int, rank int") for ids in ([1, 3, 5], [2, 3, 1])]
    got = search.rrf(lists).collect()
    assert got[0].doc_id == 1 and got[0].score == pytest.approx(1 / 61 + 1 / 63)


def test_many_vectors_are_as_one(spark):
    r = random.Random(3)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)] + [(99, None), (98, [1.0])], "vec_id int, embedding array<float>")
    q = [(7, [0.1, 0.2, 0.3, 0.4]), (8, [0.9, 0.1, 0.5, 0.5])]
    for metric in ("l2", "ip", "cosine"):
        many = search.vector_search_many(v, q, 3, metric=metric).orderBy("query_id", "rank").collect()
        for k, vec in q:
            one = search.vector_search(v, vec, 3, metric=metric).collect()
            assert [x.row_id for x in many if x.query_id == k] == [x.row_id for x in one]


def test_chunks(spark, tmp_path):
    assert readers.windows_of("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert readers.markdown_sections("pre\n# A\nx\n## B ##\ny") == [("", "pre"), ("A", "x"), ("B", "y")]
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "é" * 5)], "doc_id int, text string")
    got = [tuple(r) for r in readers.chunk_documents(d, size=4, overlap=1).orderBy("doc_id", "chunk_no").select("doc_id", "content").collect()]
    assert got == [(1, "abcd"), (1, "defg"), (1, "ghij"), (4, "éééé"), (4, "éé")]
    with pytest.raises(ValueError):
        readers.chunk_documents(d, size=3, overlap=3)
    (tmp_path / "a.md").write_text("# T\nbody")
    assert readers.ingest_files(spark, f"file://{tmp_path}/a.md", f"file://{tmp_path}/out") == 1


def test_rate_limit(spark):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz")
    got = {r.id: r.allowed for r in logs.rate_limit(d, "k", "ts", "id", 2, 60).collect()}
    for k in (0, 1):
        recent = deque()
        for i, kk, t in rows:
            if kk == k:
                while recent and (t - recent[0]).total_seconds() > 60:
                    recent.popleft()
                assert got[i] == (len(recent) < 2)
                if got[i]:
                    recent.append(t)


def test_rate_limit_stream(spark, tmp_path):
    d = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(5)], "id int, k int, ts timestamp_ntz")
    d.write.parquet(f"file://{tmp_path}/in")
    s = logs.rate_limit_stream(logs.stream_log(spark, f"file://{tmp_path}/in", d.schema), "k", "ts", "id", 3, 60)
    logs.run_available(s, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = {r.id: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_groups_frame_and_null_safe_in(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 5)], "p string, o int")
    got = relational.over_groups(d, ["p"], ["o"], -1, 0, n=F.count(F.lit(1))).orderBy("o").select("n").collect()
    assert [r.n for r in got] == [2, 2, 3, 2]
    x = spark.createDataFrame([(1,), (None,)], "x int").select(relational.in_null_safe(F.col("x"), [None]).alias("a")).collect()
    assert [r.a for r in x] == [False, True]


def test_clustered_write(spark, tmp_path):
    relational.write_clustered(spark.range(1000), f"file://{tmp_path}/c", ["id"], files=4, bloom=["id"])
    back = spark.read.parquet(f"file://{tmp_path}/c")
    spans = back.groupBy(F.col("_metadata.file_path")).agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity < 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,10.0)" in plan and "l_comment" not in plan


def test_limiter_keeps_a_stamp_of_exactly_a_window_ago():
    assert logs.allowed([0, 60, 61], 1, 60) == [True, False, True]


def test_windows_end_after_a_space():
    assert readers.windows_of("aa bb cc dd", 7, 2) == ["aa bb ", "b cc dd"] and readers.windows_of("a b", 10, 2) == ["a b"] and readers.windows_of("      x", 3, 1)[-1].endswith("x")


def test_edit_similarity_follows_the_query(spark):
    d = spark.createDataFrame([(1, "the quick fox runs"), (2, "the slow"), (3, "fox " * 30), (4, "quick the fox")], "doc_id int, text string")
    got = {r.doc_id: r.similarity for r in search.fuzzy_edit(d, "the quick fox", None).collect()}
    want = {i: search.edit_similarity("the quick fox".split(), t.split()) for i, t in ((1, "the quick fox runs"), (2, "the slow"), (3, "fox " * 30), (4, "quick the fox"))}
    assert got == pytest.approx({i: s for i, s in want.items() if s is not None}) and set(got) == {1, 2, 4}


def test_json_contains_values_as_wholes():
    from millrace.functions.json import contains_value

    assert [contains_value('{"a": [1, 2, {"b": 3}]}', t) for t in ("3", "[1, 3]", '{"b": 3}', '{"a": 1}', "1.0")] == [True, None or True, True, False, False] and contains_value("[1]", "1", "$.x") is None


def test_segments_and_merges():
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    from millrace.operators.tokenizer import UNKNOWN, Bpe

    r = random.Random(4)
    merges, tokens = [], list("abcd")
    while len(merges) < 25:
        a, b = r.choice(tokens), r.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    vocabulary = {t: i for i, t in enumerate(tokens)}
    other, own = Tokenizer(BPE(vocabulary, merges)), Bpe(vocabulary, merges)
    for _ in range(500):
        s = "".join(r.choice("abcd") for _ in range(r.randint(1, 30)))
        assert own.pieces(s) == other.encode(s).tokens, s
    assert own.encode(["a?", "b"]) == [vocabulary["a"], UNKNOWN, vocabulary["b"]]


def test_merges_in_bounded_memory(spark, monkeypatch):
    """What a worker keeps of seen words is bounded in characters, and results do not depend on the parts in which texts become objects."""
    from millrace.operators import tokenizer

    vocabulary, merges = {"a": 1, "b": 2, "ab": 3}, [("a", "b")]
    monkeypatch.setattr(tokenizer, "MEMO_CHARS", 200)
    own = tokenizer.Bpe(vocabulary, merges)
    for i in range(300):
        word = f"{i:08b}".replace("0", "a").replace("1", "b") * 3
        assert own.encode([word]) == own.encode([word]) == [vocabulary[p] for p in own.pieces(word)]
        assert sum(map(len, own.memo)) <= 200
    monkeypatch.setattr(tokenizer, "PART_BYTES", 100)
    d = spark.createDataFrame([(i, "ab ba " * (i % 40)) for i in range(200)] + [(200, None)], "doc_id int, text string").coalesce(1)
    got = {r.doc_id: r.tokens for r in tokenizer.encode(d, vocabulary, merges).collect()}
    assert got == {i: [3, tokenizer.UNKNOWN, 2, 1, tokenizer.UNKNOWN] * (i % 40) for i in range(200)} | {200: []}


def test_postings_are_counted_in_their_rows(spark):
    """No posting is shuffled; ids that rows share, and null ids, still have one posting a token."""
    d = spark.createDataFrame([(1, "a b A é"), (2, None), (3, ""), (4, "b"), (None, "c c")], "doc_id int, text string")
    p = search.postings(d)
    assert p.columns == ["token", "doc_id", "tf", "doc_len"] and "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, p.collect()), key=key) == sorted([("a", 1, 2, 4), ("b", 1, 1, 4), ("b", 4, 1, 1), ("c", None, 2, 2), ("é", 1, 1, 4)], key=key)
    assert sorted(map(tuple, search.postings(d, only=["b"]).collect())) == [("b", 1, 1, 4), ("b", 4, 1, 1)]
    twice = search.postings(d.unionAll(d)).collect()
    assert sorted(((r.token, r.doc_id, r.tf, r.doc_len) for r in twice), key=key) == sorted([("a", 1, 4, 4), ("b", 1, 2, 4), ("b", 4, 2, 1), ("c", None, 4, 2), ("é", 1, 2, 4)], key=key)


def test_text_index_shuffles_postings_once(spark, tmp_path, monkeypatch):
    """Postings that are added go to their place in the order of tokens, and are not shuffled before."""
    from millrace.operators.tables import Catalog
    from millrace.operators.text_index import TextIndex

    plans, insert = [], Catalog.insert
    monkeypatch.setattr(Catalog, "insert", lambda self, t, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or insert(self, t, df))
    index = TextIndex(Catalog(spark, f"file://{tmp_path}/db"), "d")
    index.add(spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string"))
    assert [p.count("Exchange ") for p in plans] == [1, 0]
    assert sorted(r.doc_id for r in index.search("b").collect()) == [1, 2]


def test_segments_of_classes(spark):
    from millrace.operators import tokenizer

    text = "中文abc éß 12³!? →€\n￥x"
    d = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = d.select(F.transform(tokenizer.segments("text"), lambda s: F.struct(s.alias("s"), tokenizer.class_of(s).alias("c"))).alias("x")).collect()
    assert [tuple(x) for x in got[0].x] == [("中文", "cjk"), ("abc", "letter"), (" ", "space"), ("éß", "letter"), (" ", "space"), ("12", "digit"), ("³", "symbol"), ("!?", "punct"), (" ", "space"), ("→€", "symbol"), ("\n", "space"), ("￥", "symbol"), ("x", "letter")]
    assert "".join(x.s for x in got[0].x) == text and got[1].x == got[2].x == []


def test_inverted_file(spark, tmp_path):
    """Recall of the default probe against brute force, exactness with all cells, deletes, additions and rows without a fitting vector."""
    from millrace.operators.vector_index import VectorIndex

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    for metric in ("l2", "cosine", "ip"):
        index = VectorIndex.build(e, f"file://{tmp_path}/{metric}", metric=metric)
        exact = {(r.query_id, r.row_id) for r in search.vector_search_table(e, queries, 10, metric=metric).collect()}
        got = {(r.query_id, r.row_id) for r in index.search_many(queries, 10).collect()}
        assert len(exact & got) >= 0.9 * len(exact), (metric, len(exact & got), len(exact))
        assert {(r.query_id, r.row_id) for r in index.search_many(queries, 10, probe=len(index.centres)).collect()} == exact
    q = [0.5] * 64
    first = index.search(q, 1, probe=10**6).first().row_id
    index.remove(spark.createDataFrame([(first,)], "id bigint"))
    index.add(spark.createDataFrame([(10**6, [9.0] * 64), (10**6 + 1, None), (10**6 + 2, [1.0])], "vec_id bigint, embedding array<float>"))
    top = [r.row_id for r in index.search(q, 5, probe=10**6).collect()]
    assert first not in top and top[0] == 10**6 and index.trace(q, 2).first().top[0] == 10**6


def test_chunks_in_bounded_batches(spark):
    """A long text's pieces leave a worker, and go to the embedding, in batches of bounded bytes."""
    import pandas as pd

    d = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word. "), 3_000_000).alias("text"))
    got = readers.chunk_documents(d, size=4000, overlap=0, embed=lambda s: pd.Series([[float(len(s))]] * len(s)))
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"), F.max(F.col("embedding")[0]).alias("most"), F.count_distinct("chunk_no").alias("numbers")).first()
    assert r.chars == 18_000_000 and r.n == r.numbers == 4505 and r.most * 4000 < 12_000_000


def test_inverted_file_in_passes(spark, tmp_path, monkeypatch):
    """Blocks of queries and rows give what all pairs in SQL give, to the last bit, with ties by id of any type; a cell's rows are in more tasks than one, and no join by cell gathers them."""
    from millrace.functions.dialect import install
    from millrace.operators import vector_index as vi

    r = random.Random(8)
    v = [[r.random() for _ in range(6)] for _ in range(40)]
    v = spark.createDataFrame([(i, f"k{i}", v[i % 40] if i else [0.0] * 6) for i in range(90)], "vec_id long, name string, embedding array<double>")
    q = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).unionAll(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, vector array<double>"))
    monkeypatch.setattr(search, "QUERY_PASS", 4)
    monkeypatch.setattr(vi, "ROW_BLOCK", 7)
    monkeypatch.setattr(vi, "PAIR_QUERIES", 3)
    install(spark)
    for metric, key in (("l2", "vec_id"), ("ip", "name"), ("cosine", "vec_id")):
        index = vi.VectorIndex.build(v, f"file://{tmp_path}/{metric}", id_col=key, metric=metric, cells=3)
        pairs = v.select(F.col(key).alias("row_id"), "embedding").crossJoin(q).select("query_id", "row_id", search.METRICS[metric](F.col("embedding"), F.col("vector")).alias("distance")).where("distance is not null").collect()
        want = sorted((i, rid, d, n + 1) for i in {p.query_id for p in pairs} for n, (d, rid) in enumerate(sorted((p.distance, p.row_id) for p in pairs if p.query_id == i)[:4]))
        found = index.search_many(q, 4, probe=99)
        assert sorted(map(tuple, found.collect())) == want and found.columns == ["query_id", "row_id", "distance", "rank"]
        assert index.search_many(q.limit(0), 4).count() == 0
        one = {(x.query_id, x.row_id) for x in index.search_many(q, 4, probe=1).collect()}
        assert len(one & {(i, rid) for i, rid, *_ in want}) > len(want) // 4
        assert "Join" not in found._jdf.queryExecution().toString()


def test_queries_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(50)], "vec_id int, embedding array<float>")
    q = v.where("vec_id < 17").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, search.vector_search_table(v, q, 3).collect()))
    monkeypatch.setattr(search, "QUERY_PASS", 5)
    assert sorted(map(tuple, search.vector_search_table(v, q, 3).collect())) == whole and len(whole) == 51
    assert search.vector_search_table(v, q.limit(0), 3).count() == 0


def test_text_index_over_changes(spark, tmp_path):
    from millrace.operators.tables import Catalog
    from millrace.operators.text_index import TextIndex

    c = Catalog(spark, f"file://{tmp_path}/db")
    index = TextIndex(c, "docs")
    d = spark.createDataFrame([(1, "the quick fox"), (2, "the lazy dog the end"), (3, None)], "doc_id bigint, text string")
    index.add(d)
    same = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert same(index.bm25("quick the", None)) == same(search.bm25(d, "quick the", None))
    index.remove(d.where("doc_id = 2").select("doc_id"))
    index.add(spark.createDataFrame([(2, "a quick end")], "doc_id bigint, text string"))
    now = spark.createDataFrame([(1, "the quick fox"), (2, "a quick end"), (3, None)], "doc_id bigint, text string")
    for _ in range(2):
        assert same(index.bm25("quick the end", None)) == same(search.bm25(now, "quick the end", None))
        assert [r.doc_id for r in index.search("quick end", "and").collect()] == [2] and index.bm25("nothing").count() == 0
        index.compact()
