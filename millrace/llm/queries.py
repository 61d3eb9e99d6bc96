"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, license, mixing, neardup, quality_clf, quality_rules, secrets, tokens, warc
from millrace.llm.common import crc_mod, read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = langid.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_clf.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    out = quality_clf.score_quality(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 counts before any cutoff."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds by the base patterns."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 finds by the base phrases."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def verbatim_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of op3 that hold a benchmark item word for word."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = op3_decontaminate(spark, sf_dir).select("doc_id", "item_id").distinct()
    both = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id")
    return both.where(F.contains("text", "item")).select("doc_id", "item_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_token_counts, op3_decontaminate, op4_language_id, op5_quality_rules, op6_near_duplicates, op7_secret_scan, op8_warc_round_trip, op9_license_scan, op10_quality_score, base_quality_rules, base_secret_scan, base_license_scan, verbatim_benchmark)
    return {f.__name__: f for f in own}


_SIZES = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS runs_out FROM w),
l AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS left_w, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS left_size
      FROM c WINDOW p AS (ORDER BY runs_out, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(left_size / left_w, (runs_out, source IS NULL, source)) AS served FROM l WHERE left_size / left_w < runs_out),
t AS (SELECT source, source_size, weight, coalesce(least(weight * served, cap), cap) AS target FROM l, v),
b AS (SELECT CAST(sum(size) AS BIGINT) AS budget, greatest(1, CAST(sum(size) AS BIGINT) // 131072) AS slice FROM d),
q AS (SELECT row_number() OVER (ORDER BY h) AS r, doc_id, d.source, size, source_size, target, weight, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT r, source, weight, slice, size, start + turn * source_size AS first, unnest(range(0, size, slice)) AS pos FROM q, b, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
f AS (SELECT r, source, least(slice, size - pos) AS words, CAST(first + pos + least(slice, size - pos) AS DOUBLE) / weight AS finish FROM u),
g AS (SELECT r, words, sum(words) OVER (ORDER BY finish, source IS NULL, source ROWS UNBOUNDED PRECEDING) AS through FROM f),
k AS (SELECT r, sum(greatest(0, least(words, budget - (through - words)))) AS taken FROM g, b GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (r)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
n AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head, row_number() OVER (PARTITION BY payload_digest, page_id) AS time FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id IS NULL OR page_id = head AND time = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id IS NULL OR page_id = head AND time = 1 THEN NULL ELSE head END AS refers_to, true AS complete
FROM n
"""


_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, hash(unnest(g)) AS h FROM g),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (h) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM n LEFT JOIN c ON a = doc_id
"""


_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w, t FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) > 3),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM l LEFT JOIN r ON l.doc_id = r.doc_id
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = f"(?:{'|'.join(_either_case(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SECRETS = f"""
WITH k AS (SELECT * FROM (VALUES (0, 'assign', '{_ASSIGN}', 12), (1, 'access', '(AKIA[A-Z0-9]+)', 18), (2, 'hex', '([0-9a-f]+)', 16)) AS k(k, kind, p, least)),
m AS (SELECT doc_id, 0 AS k, regexp_extract_all(coalesce(text, ''), '{_ASSIGN}') AS m, regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 1) AS v, string_split_regex(coalesce(text, ''), '{_ASSIGN}') AS s FROM documents
  UNION ALL SELECT doc_id, 1, regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), string_split_regex(coalesce(text, ''), 'AKIA[A-Z0-9]+') FROM documents
  UNION ALL SELECT doc_id, 2, regexp_extract_all(coalesce(text, ''), '[0-9a-f]{{16,}}'), regexp_extract_all(coalesce(text, ''), '[0-9a-f]{{16,}}'), string_split_regex(coalesce(text, ''), '[0-9a-f]{{16,}}') FROM documents),
f AS (SELECT doc_id, k, i, length(v[i]) AS n, length(m[i]) AS len, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
g AS (SELECT doc_id, k.k, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + len AS b FROM f JOIN k USING (k) WHERE n >= least),
h AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS told FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256 FROM documents LEFT JOIN h USING (doc_id)
"""

_LICENSES = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS (SELECT doc_id, i - 1 AS pos, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM i),
a AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN a ON w.doc_id = a.doc_id
"""

_VERBATIM = "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)"


def oracle_sql() -> dict[str, str]:
    return {"base_quality_rules": _RULES, "base_secret_scan": _SECRETS, "base_license_scan": _LICENSES, "verbatim_benchmark": _VERBATIM, "op1_mix_sources": _SIZES, "op6_near_duplicates": _NEAR, "op8_warc_round_trip": _WARC}
