"""The dialect's scalar functions as SQL functions, which Catalyst inlines: no Python worker, and one definition for SQL and DataFrames.

install(spark) declares them for a session under their names with PREFIX. call("mod", a, b) applies one to Columns, and
operators.engine.Engine rewrites plain calls in SQL text, so MOD(a, b) means mr_mod(a, b) there. All are NULL for a NULL argument unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PREFIX = "mr_"

_UNITS = {
    "MILLISECOND": "('ms', 'millisecond', 'milliseconds')", "SECOND": "('s', 'sec', 'second', 'seconds')", "MINUTE": "('min', 'minute', 'minutes')",
    "HOUR": "('h', 'hour', 'hours')", "DAY": "('d', 'day', 'days')", "WEEK": "('w', 'week', 'weeks')",
}


def _by_unit(body: str, rest: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN lower(unit) IN {names} THEN {body.replace('@', unit)}" for unit, names in _UNITS.items()) + f" ELSE {rest} END"


#: name: (parameters, result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # integers: overflow and division by zero are NULL, division truncates
    "add": ("a BIGINT, b BIGINT", "BIGINT", "try_add(a, b)"),
    "subtract": ("a BIGINT, b BIGINT", "BIGINT", "try_subtract(a, b)"),
    "multiply": ("a BIGINT, b BIGINT", "BIGINT", "try_multiply(a, b)"),
    "divide": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = (-9223372036854775807L - 1L) AND b = -1 THEN NULL ELSE a DIV nullif(b, 0L) END"),
    "remainder": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN b = -1 THEN 0L ELSE a % nullif(b, 0L) END"),
    "mod": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN b = 0 THEN NULL WHEN b IN (1, -1) THEN 0L WHEN a % b < 0 THEN a % b + abs(b) ELSE a % b END"),
    "fdivide": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b = 0 THEN CAST('NaN' AS DOUBLE) ELSE a / b END"),
    # math
    "trunc": ("x DOUBLE", "DOUBLE", "CASE WHEN x < 0 THEN CAST(ceil(x) AS DOUBLE) ELSE CAST(floor(x) AS DOUBLE) END"),
    "log": ("x DOUBLE", "DOUBLE", "log10(x)"),
    # strings
    "substr2": ("s STRING, start INT", "STRING", "substring(s, greatest(start, 1))"),
    "substr3": ("s STRING, start INT, n INT", "STRING", "substring(s, greatest(start, 1), greatest(n, 0))"),
    "trim": ("s STRING", "STRING", r"regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '')"),
    "ltrim": ("s STRING", "STRING", r"regexp_replace(s, '^[\\s\\p{Z}]+', '')"),
    "rtrim": ("s STRING", "STRING", r"regexp_replace(s, '[\\s\\p{Z}]+$', '')"),
    "trim2": ("s STRING, chars STRING", "STRING", "CASE WHEN chars = '' THEN s ELSE trim(BOTH chars FROM s) END"),
    "ltrim2": ("s STRING, chars STRING", "STRING", "CASE WHEN chars = '' THEN s ELSE trim(LEADING chars FROM s) END"),
    "rtrim2": ("s STRING, chars STRING", "STRING", "CASE WHEN chars = '' THEN s ELSE trim(TRAILING chars FROM s) END"),
    "instr": ("s STRING, part STRING", "INT", "instr(s, part)"),
    "split_part": ("s STRING, sep STRING, n INT", "STRING", "CASE WHEN s IS NULL OR sep IS NULL OR n IS NULL THEN NULL WHEN n < 1 THEN '' WHEN sep = '' THEN CASE WHEN n = 1 THEN s ELSE '' END ELSE split_part(s, sep, greatest(n, 1)) END"),
    "match": ("s STRING, query STRING", "BOOLEAN", r"forall(filter(split(lower(query), '\\s+'), t -> t <> ''), t -> contains(lower(s), t))"),
    # dates and times, UTC
    "date": ("t TIMESTAMP_NTZ", "STRING", "date_format(t, 'yyyy-MM-dd')"),
    "time": ("t TIMESTAMP_NTZ", "STRING", "date_format(t, 'HH:mm:ss')"),
    "datetime": ("t TIMESTAMP_NTZ", "STRING", "date_format(t, 'yyyy-MM-dd HH:mm:ss')"),
    "date_add": ("t TIMESTAMP_NTZ, n BIGINT, unit STRING", "TIMESTAMP_NTZ", _by_unit("timestampadd(@, n, t)", "t")),
    "date_sub": ("t TIMESTAMP_NTZ, n BIGINT, unit STRING", "TIMESTAMP_NTZ", _by_unit("timestampadd(@, -n, t)", "t")),
    "date_diff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ, unit STRING", "BIGINT", _by_unit("timestampdiff(@, b, a)")),
    "date_trunc": ("unit STRING, t TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "CASE WHEN lower(unit) IN ('year', 'quarter', 'month', 'week', 'day', 'hour', 'minute', 'second') THEN CAST(date_trunc(unit, t) AS TIMESTAMP_NTZ) ELSE t END"),
    "date_trunc_week_sunday": ("t TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "timestampadd(DAY, 1L - dayofweek(t), CAST(date_trunc('day', t) AS TIMESTAMP_NTZ))"),
    # JSON that is read only; what writes it is in functions.json
    "json_extract": ("j STRING, path STRING", "STRING", "to_json(try_variant_get(try_parse_json(j), path, 'variant'))"),
    "json_array_length": ("j STRING", "INT", "json_array_length(j)"),
    "json_array_length2": ("j STRING, path STRING", "INT", "json_array_length(get_json_object(j, path))"),
    # vectors: NULL unless the dimensions agree
    "vector_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)) END"),
    "vector_l2_squared": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v) END"),
    "vector_inner": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) END"),
    "vector_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN a IS NOT NULL THEN sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) END"),
    "vector_cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D), 0D) END",
    ),
}

#: Calls that mean the same function, by name.
ALIASES = {
    "len": "length", "ucase": "upper", "lcase": "lower", "position": "instr", "ceiling": "ceil", "truncate": "trunc", "pow": "power", "log10": "log", "rand": "rand", "random": "rand",
    "date_bin": "date_trunc", "vector_distance": "vector_l2", "vec_distance": "vector_l2", "vector_l2_distance": "vector_l2", "substring": "substr",
}
#: Functions whose name depends on the number of arguments.
BY_ARITY = {"substr": {2: "substr2", 3: "substr3"}, "trim": {1: "trim", 2: "trim2"}, "ltrim": {1: "ltrim", 2: "ltrim2"}, "rtrim": {1: "rtrim", 2: "rtrim2"}, "json_array_length": {1: "json_array_length", 2: "json_array_length2"}}


def install(spark: SparkSession) -> None:
    """Declares every function in the session; once is enough, and again does no harm."""
    known = {r.function for r in spark.sql(f"SHOW USER FUNCTIONS LIKE '{PREFIX}*'").collect()}
    for name, (params, result, body) in FUNCTIONS.items():
        if not any(k.endswith(PREFIX + name) for k in known):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({params}) RETURNS {result} RETURN {body}")


def target(name: str, arity: int) -> str | None:
    """The installed function that a call by name and number of arguments means; None where Spark's own is meant."""
    n = ALIASES.get(name.lower(), name.lower())
    n = BY_ARITY.get(n, {}).get(arity, n)
    return PREFIX + n if n in FUNCTIONS else n if n != name.lower() else None


def call(name: str, *args) -> Column:
    """A dialect function on Columns (strings are column names; use F.lit for text)."""
    cols = [F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args]
    return F.call_function(target(name, len(cols)) or name, *cols)


def sum_double(x: Column) -> Column:
    """SUM as the dialect has it: DOUBLE whatever the input."""
    return F.sum(x.cast("double"))


#: strftime letters that are Spark patterns.
_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def _strftime() -> str:
    """%Y %y %m %d %H %M %S, %w (0 is Sunday), %j (day of the year), %U (week of the year, weeks from Sunday), %%."""
    parts = {f"%{c}": f"date_format(t, '{p}')" for c, p in _LETTERS.items()}
    parts |= {"%w": "CAST(dayofweek(t) - 1 AS STRING)", "%j": "lpad(CAST(dayofyear(t) AS STRING), 3, '0')", "%U": "lpad(CAST((dayofyear(t) - dayofweek(t) + 7) DIV 7 AS STRING), 2, '0')"}
    out = "replace(fmt, '%%', chr(1))"
    for c, x in parts.items():
        out = f"replace({out}, '{c}', {x})"
    return f"replace({out}, chr(1), '%')"


FUNCTIONS["strftime"] = ("fmt STRING, t TIMESTAMP_NTZ", "STRING", _strftime())
FUNCTIONS["strptime"] = ("fmt STRING, s STRING", "TIMESTAMP_NTZ", "CAST(try_to_timestamp(s, " + "".join("replace(" for _ in _LETTERS) + "regexp_replace(fmt, '(?<!%)([A-Za-z])', concat(chr(39), '$1', chr(39)))" + "".join(f", '%{c}', '{p}')" for c, p in _LETTERS.items()) + ") AS TIMESTAMP_NTZ)")


def strptime(fmt: str, s: Column | str) -> Column:
    """A timestamp (without zone) from text under a literal format of year, month, day and time; NULL where it does not fit."""
    s = F.col(s) if isinstance(s, str) else s
    pattern, k = "", 0
    while k < len(fmt):
        if fmt[k] == "%" and fmt[k + 1 : k + 2] in _LETTERS:
            pattern, k = pattern + _LETTERS[fmt[k + 1]], k + 2
        else:
            pattern, k = pattern + (f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]), k + 1
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")


_TYPES = {"boolean": "boolean", "tinyint": "int32", "smallint": "int32", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "varchar", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "binary": "blob", "variant": "json", "void": "null"}


def type_name(spark_type: str, logical: str | None = None) -> str:
    if logical:
        return logical
    if spark_type.startswith("array"):
        return "vector"
    if spark_type.startswith("struct<q:array<tinyint>"):
        return "vector_int8"
    return _TYPES.get(spark_type, spark_type)


def type_of_text(x: str) -> str:
    """TYPEOF(x) in SQL text."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())
    return f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) LIKE 'array%' THEN 'vector' ELSE CASE typeof({x}) {cases} ELSE typeof({x}) END END"


def type_of(df, column: str) -> Column:
    """TYPEOF: the dialect's name of a column's type, 'null' where the value is NULL."""
    field = df.schema[column]
    return F.when(F.col(f"`{column}`").isNull(), F.lit("null")).otherwise(F.lit(type_name(field.dataType.simpleString(), (field.metadata or {}).get("logical"))))


# --- INT8 vectors ---------------------------------------------------------------------------------------------------


def quantize_int8(v: Column | str) -> Column:
    """struct(q, scale, offset) of a float vector: [min, max] goes to [-127, 127]; a constant vector has scale 0 and zeros."""
    v = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    lo, hi = F.array_min(v), F.array_max(v)
    scale, offset = (hi - lo) / 254.0, (hi + lo) / 2.0
    q = F.transform(v, lambda x: F.when(scale > 0, F.round((x - offset) / F.nullif(scale, F.lit(0.0)))).otherwise(F.lit(0.0)).cast("tinyint"))
    return F.when(F.size(v) > 0, F.struct(q.alias("q"), scale.cast("float").alias("scale"), offset.cast("float").alias("offset")))


def dequantize_int8(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c["q"], lambda x: x.cast("double") * c["scale"].cast("double") + c["offset"].cast("double"))
