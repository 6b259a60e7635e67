"""WARC archives: writing with payload deduplication, chunked framing and segmented records; reading with segment
reassembly (continuation records grouped by origin identifier, ordered by segment number, total length verified)
and decoding of the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, shared_folder, table

#: Code points in a chunk of the transfer framing, and in a segment of a record.
CHUNK, SEGMENT = 4096, 16384
#: A file holds so many records of at most a segment each, that is 200 MB before compression and mostly a few.
RECORDS_A_FILE = 4_000
#: Digests of repeated payloads are broadcast up to so many rows, so that payloads are not shuffled for them.
BROADCAST_DIGESTS = 200_000
DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEAD = r"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(hex_column: str) -> "F.Column":
    """Base32 of the 40 hexadecimal digits in `hex_column`: eight times 5 digits are 4 letters."""
    parts = []
    for i in range(8):
        n = f"cast(conv(substr({hex_column}, {5 * i + 1}, 5), 16, 10) as int)"
        parts += [f"substr('{_BASE32}', (shiftright({n}, {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return F.expr("concat(" + ", ".join(parts) + ")")


def write_warc(df: DataFrame, path: str, id_column: str, url_column: str, text_column: str, least_bytes: int = 0) -> None:
    """One record for each row, in gzip-compressed WARC files below `path`.

    Of rows with equal payloads of at least `least_bytes` bytes those with the smallest id are responses, the others
    revisits (also those without an id, if any has one). Null texts are empty payloads, null URLs are left out, repeated
    rows are records each, an empty table gives an archive without records.
    """
    rows = df.select(df[id_column].alias("id"), df[url_column].cast("string").alias("url"), F.coalesce(df[text_column], F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha1(F.col("text").cast("binary"))).withColumn("bytes", F.octet_length("text"))
    first = rows.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    rows = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "sha", "left").withColumn("revisit", F.coalesce((F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))), F.lit(False)))
    chunks = F.expr(rf"array_join(transform(regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0), c -> concat(hex(octet_length(c)), '\r\n', c, '\r\n')), '')")
    rows = rows.withColumn("origin", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).withColumn("digest", base32_sha1("sha"))
    rows = rows.withColumn("block", F.when(F.col("revisit"), F.expr(rf"'{_HEAD}\r\n'")).otherwise(F.concat(F.expr(rf"'{_HEAD}Transfer-Encoding: chunked\r\n\r\n'"), chunks, F.expr(r"'0\r\n\r\n'"))))
    rows = rows.withColumn("parts", F.expr(f"regexp_extract_all(block, '(?s).{{1,{SEGMENT}}}', 0)"))
    field = lambda name, value: rf"coalesce(concat('{name}: ', {value}, '\r\n'), '')"  # noqa: E731  nothing for a null value
    first_record = (
        rf"concat('WARC/1.1\r\nWARC-Type: ', if(revisit, 'revisit', 'response'), '\r\nWARC-Record-ID: ', origin, '\r\nWARC-Date: {DATE}\r\n', "
        + field("WARC-Target-URI", r"regexp_replace(url, '[\r\n]+', '')")
        + r", 'WARC-Payload-Digest: sha1:', digest, '\r\n', "
        + field("X-Page-Id", "cast(id as string)")
        + r", if(revisit, concat('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-Id: ', cast(first as string), '\r\n'), '')"
        + r", if(size(parts) > 1, 'WARC-Segment-Number: 1\r\n', ''), 'Content-Type: application/http; msgtype=response\r\nContent-Length: ', octet_length(p), '\r\n\r\n', p)"
    )
    later_record = (
        rf"concat('WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: ', replace(origin, '>', concat('-', i + 1, '>')), '\r\nWARC-Date: {DATE}\r\nWARC-Segment-Origin-ID: ', origin, "
        r"'\r\nWARC-Segment-Number: ', i + 1, '\r\n', if(i + 1 = size(parts), concat('WARC-Segment-Total-Length: ', octet_length(block), '\r\n'), ''), 'Content-Length: ', octet_length(p), '\r\n\r\n', p)"
    )
    records = rows.select(F.explode_outer(F.expr(f"transform(parts, (p, i) -> if(i = 0, {first_record}, {later_record}))")).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


_PARSED = [("record_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("block", pa.binary())]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of whole archive files, by their content lengths."""
    rows: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_PARSED)], [k for k, _ in _PARSED])

    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
            f = io.BufferedReader(f, 1 << 20)
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue  # the blank lines between records
                head: dict[bytes, str] = {}
                while (line := f.readline().rstrip(b"\r\n")):
                    name, _, value = line.partition(b":")
                    head[name.lower()] = value.strip().decode("utf-8", "replace")
                block = f.read(int(head.get(b"content-length", 0)))
                kind, number = head.get(b"warc-type"), head.get(b"warc-segment-number")
                origin = head.get(b"warc-segment-origin-id") or head.get(b"warc-record-id")
                rows.append((kind, origin, number and int(number), (t := head.get(b"warc-segment-total-length")) and int(t), head.get(b"x-page-id"), head.get(b"x-refers-to-page-id"), head.get(b"warc-target-uri"), head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, block))
                held += len(block)
                if held > 4 << 20:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def dechunk(body: bytes) -> bytes:
    """The content of a body in chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def _whole(parts: list[dict]) -> tuple[bytes | None, str | None]:
    """Payload of a record from its segments, or what is wrong with it."""
    numbers = [p["segment"] for p in parts]
    if len(parts) > 1 or numbers[0] is not None:
        if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
            return None, "segments are missing or repeated"
        if sum(len(p["block"]) for p in parts) != parts[-1]["total"]:
            return None, "the total length differs"
    block = b"".join(p["block"] for p in parts)
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        try:
            return dechunk(body), None
        except ValueError as e:
            return None, f"chunked framing: {e}"
    return body, None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            done = [_whole(parts) for parts in part.column(part.schema.get_field_index("parts")).to_pylist()]
            rest = [i for i, name in enumerate(part.schema.names) if name != "parts"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array([p for p, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], [*(part.schema.names[i] for i in rest), "payload", "error"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`: record_type, id, refers_to, url, digest, payload (binary), error.

    A record whose segments are missing, repeated or of another total length, or whose framing is broken, has a null
    payload and says why in `error`; it is not dropped.
    """
    arrow_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(_parse, "record_type string, origin string, segment int, total long, id string, refers_to string, url string, digest string, block binary")
    first = lambda c: F.max(F.when(F.col("record_type") != "continuation", F.col(c))).alias(c)
    grouped = parsed.groupBy("origin").agg(*map(first, ("record_type", "id", "refers_to", "url", "digest")), F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"))
    return grouped.drop("origin").mapInArrow(_decode, "record_type string, id string, refers_to string, url string, digest string, payload binary, error string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives"
    write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    read = read_warc(spark, path).withColumn("sha", F.sha1("payload"))
    read = read.select(F.col("id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("own_bytes"), base32_sha1("sha").alias("own_digest"), "digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    # a revisit has its payload's bytes from the response that it refers to; both digests must agree
    told = read.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("digest")).agg(F.max("own_bytes").alias("told_bytes"))
    revisit = F.col("record_type") == "revisit"
    out = read.join(told, ["refers_to", "digest"], "left")
    return out.select("page_id", F.when(revisit, F.col("told_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to")


_LETTERS = ", ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, concat({_LETTERS}) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {"op3_warc": _SQL}
