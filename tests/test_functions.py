import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import json as J
from millrace.functions.dialect import call, dequantize_int8, install, quantize_int8
from millrace.functions.udf import Registry, square, strlen


@pytest.fixture(scope="module")
def one(spark):
    install(spark)
    return spark.range(1)


def val(one, *cols):
    return tuple(one.select(*cols).first())


def test_integers(one):
    lo, hi = -(2**63), 2**63 - 1
    x = lambda v: F.lit(v).cast("long")
    assert val(one, call("add", x(hi), x(1)), call("multiply", x(hi), x(2)), call("divide", x(7), x(0)), call("divide", F.lit(-7), F.lit(2)), call("remainder", F.lit(-7), F.lit(3)), call("remainder", x(1), x(0))) == (None, None, None, -3, -1, None)
    assert val(one, call("divide", x(lo), x(-1)), call("mod", x(lo), x(-1))) == (None, 0)


def test_mod_is_euclidean(spark, one):
    r = random.Random(1)
    pairs = [(r.randint(-99, 99), r.randint(-9, 9)) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", call("mod", "a", "b").alias("m")).collect()
    for a, b, m in got:
        assert m == (None if b == 0 else a % abs(b))


def test_strings(one):
    s = F.lit("héllo")
    assert val(one, call("substr", s, 0, 2), call("substr", s, -5, 2), call("substr", s, 2), call("substr", s, 99, 1)) == ("hé", "hé", "éllo", "")
    assert val(one, call("split_part", F.lit("a,b"), F.lit(","), 0), call("split_part", F.lit("a,b"), F.lit(","), 2), call("split_part", F.lit("a,b"), F.lit(","), 9)) == ("", "b", "")
    assert val(one, call("trim", F.lit(" \t x ")), call("trim", F.lit("xxaxx"), F.lit("x")), call("instr", s, F.lit("l")), call("position", s, F.lit("z"))) == ("x", "a", 3, 0)
    assert val(one, call("match", F.lit("Alpha beta"), F.lit("BETA alph")), call("match", F.lit("Alpha"), F.lit("gamma"))) == (True, False)


def test_math(one):
    assert val(one, call("truncate", F.lit(-2.7)), call("log", F.lit(1000.0)), F.round(F.lit(2.5)), F.round(F.lit(-2.5))) == (-2.0, 3.0, 3.0, -3.0)


def test_dates(one):
    t = F.lit("2024-03-03 04:05:06").cast("timestamp_ntz")  # a Sunday
    assert val(one, call("date", t), call("time", t), call("datetime", t)) == ("2024-03-03", "04:05:06", "2024-03-03 04:05:06")
    assert val(one, call("strftime", F.lit("%Y|%y|%w|%j|%U|%%Y"), t)) == ("2024|24|0|063|09|%Y",)
    assert val(one, call("strptime", F.lit("%Y/%m/%d %H:%M"), F.lit("2024/03/03 04:05")), call("strptime", F.lit("%Y-%m-%d"), F.lit("x"))) == (dt.datetime(2024, 3, 3, 4, 5), None)
    assert val(one, call("date_trunc", F.lit("week"), t), call("date_trunc_week_sunday", t)) == (dt.datetime(2024, 2, 26), dt.datetime(2024, 3, 3))
    assert val(one, call("date_add", t, 1, F.lit("w")), call("date_sub", t, 6, F.lit("s")), call("date_add", t, 1, F.lit("no unit"))) == (dt.datetime(2024, 3, 10, 4, 5, 6), dt.datetime(2024, 3, 3, 4, 5), dt.datetime(2024, 3, 3, 4, 5, 6))
    assert val(one, call("date_diff", t, F.lit("2024-03-01 05:00:00").cast("timestamp_ntz"), F.lit("day")), call("date_diff", t, t, F.lit("no unit"))) == (1, None)


def test_json_reading(one):
    j = F.lit('{"a":{"b":["x",1]}}')
    assert val(one, call("json_extract", j, F.lit("$.a.b[0]")), call("json_extract", j, F.lit("$.a.c")), call("json_extract", F.lit("{"), F.lit("$.a"))) == ('"x"', None, None)
    assert val(one, call("json_array_length", j, F.lit("$.a.b")), call("json_array_length", j)) == (2, None)


def test_json_writing():
    assert J.change('{"a":1}', "$.b", "2", "set") == '{"a":1,"b":2}'
    assert J.change('{"a":1}', "$.a", "2", "insert") == '{"a":1}'
    assert J.change('{"a":1}', "$.a", "text", "replace") == '{"a":"text"}'
    assert J.change('{"a":1}', "$.b", "2", "replace") == '{"a":1}'
    assert J.change('{"a":[1,2,3]}', "$.a[1]", None, "remove") == '{"a":[1,3]}'
    assert J.change("{bad", "$.a", "1", "set") is None and J.change(None, "$.a", "1", "set") is None
    assert J.contains_value('{"tags":["ai","db"]}', '["db","ai"]', "$.tags") is True
    assert J.contains_value('{"tags":["ai"]}', '"x"', "$.tags") is False and J.contains_value("{", '"x"') is None


def test_json_columns(one):
    assert val(one, J.json_object("k", F.lit(1), "s", F.lit("x"), "d", F.lit('{"z":null}')), J.json_array(F.lit(1.5), F.lit(None).cast("int"))) == ('{"d":{"z":null},"k":1,"s":"x"}', "[1.5,null]")


def test_vectors(one):
    a, b, z, e = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0)), F.array().cast("array<double>")
    assert val(one, call("vector_distance", a, b), call("vector_distance", a, z), call("vector_cosine_similarity", a, b), call("vector_cosine_similarity", e, e), call("vector_norm", a)) == (5.0, None, 0.0, None, 5.0)
    q, back = val(one, quantize_int8(a), dequantize_int8(quantize_int8(a)))
    assert list(q["q"]) == [-127, 127] and back == pytest.approx([3.0, 4.0])


def test_registry(spark):
    r = Registry(spark)
    r.register("millrace_strlen", strlen, "bigint")
    r.register("millrace_sq", square, "double")
    with pytest.raises(ValueError):
        r.register("MILLRACE_SQ", square, "double")
    assert [x[0] for x in r.list()] == ["millrace_sq", "millrace_strlen"]
    assert tuple(spark.sql("SELECT millrace_strlen('abc'), millrace_sq(3D)").first()) == (3, 9.0)
    assert r.unregister("millrace_sq") and not r.unregister("millrace_sq") and r.get("Millrace_StrLen") is not None
