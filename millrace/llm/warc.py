"""WARC archives: writing segmented, chunked and deduplicated records, and putting them together again."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import flat_map_batches, fresh_path, written

#: Payloads of at least so many bytes are shared by revisits.
LEAST_REVISIT = 100
#: Code points in a segment's block and in a chunk of the transfer framing.
SEGMENT_CHARS = 65_536
CHUNK_CHARS = 8_192
#: Rows in an archive file at most: a reader holds one file at a time.
FILE_ROWS = 1_000
CRLF = "\r\n"
_EPOCH = "1970-01-01T00:00:00Z"


def _pieces(text: Column, chars: int) -> Column:
    """The text cut into strings of so many code points; an empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / chars).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * chars + 1, F.lit(chars)))


def chunked(text: Column, chars: int = CHUNK_CHARS) -> Column:
    """HTTP chunked transfer framing: sizes in bytes, in hexadecimal, and a last chunk of size 0."""
    parts = F.filter(_pieces(text, chars), lambda x: x != "")
    framed = F.transform(parts, lambda x: F.concat(F.lower(F.hex(F.octet_length(x))), F.lit(CRLF), x, F.lit(CRLF)))
    return F.concat(F.concat_ws("", framed), F.lit("0" + CRLF + CRLF))


def _header(kind: Column, record: Column, extra: Column, block: Column) -> Column:
    fixed = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: <"), record, F.lit(">" + CRLF + f"WARC-Date: {_EPOCH}" + CRLF)]
    return F.concat(*fixed, extra, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def plan(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """(responses with url and html, revisits), each with page_id, payload_digest, payload_bytes.

    Equal payloads meet by digest in narrow aggregations (counts and minima, combined before the shuffle), so that a payload which a
    third of the pages share is no hot task. The html is shuffled once, to meet the responses' keys; revisits need none, but have their own url.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    same = ["page_id", "payload_digest", "payload_bytes"]
    by_url = written(base.groupBy(*same, "url").agg(F.count(F.lit(1)).alias("rows")), "pages")
    groups = by_url.groupBy(*same).agg(F.sum("rows").alias("rows"), F.min("url").alias("head_url"))
    first = groups.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.sum("rows").alias("total")).where("total > 1").select("payload_digest", "first")
    g = written(groups.join(first, "payload_digest", "left").withColumn("first", F.when((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull(), F.col("first"))), "plan")
    later = g.where(F.col("first").isNotNull()).select(*same, "first", "head_url")
    is_head = (F.col("page_id") == F.col("first")) & F.col("url").eqNullSafe(F.col("head_url"))
    times = F.col("rows") - F.when(is_head, 1).otherwise(0)
    revisits = by_url.join(later, same).where(times > 0).select("page_id", "url", "payload_digest", "payload_bytes", F.col("first").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("time")).drop("time")

    def of(keys: DataFrame) -> DataFrame:
        k = keys.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"))
        return base.join(k, (F.col("payload_digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left_semi")

    responses = of(g.where("first is null or (first = page_id and rows = 1)"))
    repeated = g.where("first = page_id and rows > 1")
    if repeated.limit(1).count():  # of rows that repeat id and payload one is the response
        again = of(repeated).groupBy("page_id", "payload_digest", "payload_bytes").agg(F.min("url").alias("url"), F.first("html").alias("html"))
        responses = responses.unionAll(again.select(*responses.columns))
    return responses, revisits


def records(responses: DataFrame, revisits: DataFrame, *, least: int = LEAST_REVISIT, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """value: every WARC record as text, without the two line ends that close it.

    A response's block is its HTTP head and its chunk-framed payload. A long one is cut into segments: the first in the response itself, the others
    in continuation records that name it as their origin, the last with the block's total length.
    """
    r = responses.withColumn("rid", F.when(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least), F.concat(F.lit("urn:page:"), "page_id", F.lit(":"), "payload_digest")).otherwise(F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))))
    r = r.withColumn("block", F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + CRLF * 2), chunked(F.col("html"), chunk_chars)))
    r = r.withColumn("total", F.octet_length("block")).select("rid", "page_id", "url", "payload_digest", "payload_bytes", "total", F.posexplode(_pieces(F.col("block"), segment_chars)).alias("at", "part"), F.ceil(F.length("block") / segment_chars).alias("segments"))
    uri = F.coalesce(F.translate("url", CRLF, ""), F.lit("urn:none"))
    number = F.when(F.col("segments") > 1, _line("WARC-Segment-Number", (F.col("at") + 1).cast("string"))).otherwise(F.lit(""))
    page = F.coalesce(_line("X-Page-Id", F.col("page_id").cast("string")), F.lit(""))
    whole = F.concat(_line("WARC-Target-URI", uri), page, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), _line("X-Payload-Length", F.col("payload_bytes").cast("string")))
    head = _header(F.lit("response"), F.col("rid"), F.concat(whole, number), F.col("part"))
    last = F.when(F.col("at") + 1 == F.col("segments"), _line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(F.lit(""))
    more = _header(F.lit("continuation"), F.concat("rid", F.lit(":"), F.col("at") + 1), F.concat(_line("WARC-Target-URI", uri), _line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "rid", F.lit(">"))), number, last), F.col("part"))
    again = revisits.withColumn("rid", F.concat(F.lit("urn:uuid:"), F.expr("uuid()")))
    fields = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
        _line("WARC-Target-URI", uri), page, _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), "refers_to", F.lit(":"), "payload_digest", F.lit(">"))), _line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
    )
    return r.select(F.when(F.col("at") == 0, head).otherwise(more).alias("value")).unionAll(again.select(_header(F.lit("revisit"), F.col("rid"), fields, F.lit("")).alias("value")))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, file_rows: int = FILE_ROWS) -> None:
    """WARC files (gzip) at path, a record for each row of pages, and continuations. Spark's writer commits them, so a lost executor leaves no half file.

    A null html is an empty payload. A row without an id is a response whatever its payload. Of rows that repeat id and payload (of LEAST_REVISIT bytes
    or more) one is the response. An empty table makes archives without records. Other columns are ignored.
    """
    rows = records(*plan(pages, id_col=id_col, html_col=html_col, url_col=url_col, least=least), least=least, segment_chars=segment_chars, chunk_chars=chunk_chars)
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(path)


def parse(data: bytes):
    """(fields, block) of every record of an archive, by its lengths alone."""
    at = 0
    while at < len(data):
        if (end := data.find(b"\r\n\r\n", at)) < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, data[start:stop]
        at = stop + 4


def dechunk(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    low = head.lower()
    if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", low):
        return dechunk(body)
    m = re.search(rb"\r\ncontent-length:\s*(\d+)", low)
    return body[: int(m[1])] if m else body


def reassemble(segments: list[tuple[int, bytes]], total: int | None) -> bytes | None:
    """The block of a record from its segments in any order; None unless they are all there, once each, with the total length."""
    segments = sorted(segments)
    block = b"".join(b for _, b in segments)
    return block if [n for n, _ in segments] == list(range(1, len(segments) + 1)) and total == len(block) else None


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_archives(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, complete and (if payloads) payload of every record.

    Files are read whole by Spark's binary reader, and records found by their lengths. Whole records are decoded where they are read;
    segments meet by their origin's identifier, are ordered by number and checked against the total length. What lacks a
    segment, does not add up, or does not have the digest that its record states has complete = false. A revisit has the length and
    digest that its record states. Segments of one record are all that one task gathers.
    """
    long, text, blob = T.LongType(), T.StringType(), T.BinaryType()
    raw = T.StructType([T.StructField(n, k) for n, k in (("key", text), ("page_id", long), ("url", text), ("record_type", text), ("refers_to", long), ("stated", text), ("bytes", long), ("seg", long), ("total", long), ("block", blob), ("digest", text))])

    def make():
        import gzip

        def run(contents):
            rows = []
            for c in contents:
                data = gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c
                for f, block in parse(data):
                    kind, seg = f["warc-type"], f.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    key = _bare(f.get("warc-segment-origin-id")) or _bare(f.get("warc-record-id"))
                    page, refers, size, total = (int(f[n]) if n in f else None for n in ("x-page-id", "x-refers-to-page", "x-payload-length", "warc-segment-total-length"))
                    stated = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    digest = stated if kind == "revisit" else None
                    if kind == "response" and seg is None:
                        block = payload_of(block)
                        digest, size = hashlib.sha256(block).hexdigest(), len(block)
                    url = f.get("warc-target-uri")
                    rows.append((key, page, None if url == "urn:none" else url, kind, refers, stated, size, int(seg) if seg else None, total, block if seg or payloads else None, digest))
            return list(zip(*rows, strict=True)) if rows else [[]] * len(raw)

        return run

    # one file's records at a time: files are bounded, batches of files would not be
    files = spark.read.format("binaryFile").load(path).select("content")
    got = _one_by_one(files, make, raw)
    got = written(got, "records")
    whole = got.where("seg is null").select("page_id", "url", "record_type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), (F.col("digest") == F.col("stated")).alias("complete"), F.col("block").alias("payload"))
    parts = got.where("seg is not null").groupBy("key").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("stated").alias("stated"), F.max("total").alias("total"), F.collect_list(F.struct("seg", "block")).alias("parts"),
    )

    def join():
        def run(pages, urls, stated, totals, lists):
            out = []
            for page, url, s, total, segs in zip(pages, urls, stated, totals, lists, strict=True):
                block = reassemble([(x["seg"], x["block"]) for x in segs], total)
                p = payload_of(block) if block is not None else None
                d = hashlib.sha256(p).hexdigest() if p is not None else s
                out.append((page, url, "response", None, len(p) if p is not None else None, d, p is not None and d == s, p if payloads else None))
            return list(zip(*out, strict=True))

        return run

    segmented = flat_map_batches(parts, join, T.StructType([*whole.schema.fields]), ["page_id", "url", "stated", "total", "parts"])
    out = whole.unionAll(segmented)
    return out if payloads else out.drop("payload")


def _one_by_one(files: DataFrame, make, schema: T.StructType) -> DataFrame:
    def each():
        fn = make()

        def run(contents):
            parts = [fn([c]) for c in contents]
            return [[x for p in parts for x in p[i]] for i in range(len(schema))]

        return run

    return flat_map_batches(files, each, schema, ["content"])


def round_trip(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT, payloads: bool = False) -> DataFrame:
    """read_archives of write_archives, by way of the shared folder."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col, html_col=html_col, url_col=url_col, least=least)
    return read_archives(pages.sparkSession, path, payloads=payloads)
