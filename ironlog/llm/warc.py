"""WARC archives: written by Spark's text writer, read back by a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ironlog.llm.common import new_path, stored

#: Records in an archive, unless its longest pages could make it larger than MOST_BYTES; pages above LONG bytes have archives of their own.
RECORDS, MOST_BYTES, LONG = 2048, 128 << 20, 1 << 18
#: Bytes unpacked at a time from a damaged member.
STEP = 4096
#: Repeated payloads are looked up in a broadcast table up to so many, in a join beyond.
SMALL = 100_000
BREAK = "\r\n"
#: RFC 4648 alphabet, and the digits that base 32 numbers have in SQL. Fixed values.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_GZIP = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: each 20 bits, five hexadecimal digits, are four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks inside a value are escaped."""
    value = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads the row with the smallest page_id is the response and the others revisit it; rows that share that
    page_id are all responses.  Rows without page_id are revisits if another row has their payload, else responses.

    Digests are taken in one pass without the payloads.  What repeats is broadcast if it is at most SMALL digests, else joined;
    either way a payload that a third of all rows share is one row of that table.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"))
    same = ["payload_digest", "payload_bytes"]
    repeated = stored(rows.groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "repeated")
    count = repeated.count()
    if not count:
        joined = rows.withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType))
    else:
        joined = rows.join(F.broadcast(repeated) if count <= SMALL else repeated, same, "left")
    revisits = F.col("first").isNotNull() & F.coalesce(F.col("first") != F.col("page_id"), F.lit(True))
    return joined.select(
        "page_id", "url", "payload", *same[::-1],
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Uncompressed WARC 1.1 files under ``path``: one record per page, written where the page was read.

    A record ends with two line breaks, which is what separates the lines of Spark's text writer here, so the files need
    no other writer and go to any store that Spark writes.  ``X-Payload-Length`` holds the full payload's length in revisits.

    Pages of more than LONG bytes go to archives of their own, so that a few of them do not make all others small.
    """
    rows = with_revisits(pages)
    tall = F.col("payload_bytes") > LONG
    sizes = F.max(F.when(~tall, F.col("payload_bytes"))), F.max(F.when(tall, F.col("payload_bytes")))
    longest = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("payload_bytes")).agg(*sizes).first()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(BREAK * 2),
    )
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    name = lambda c: F.concat(F.lit("<urn:ironlog:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", name(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _field("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), name(F.col("refers_to")))),
        _field("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(BREAK),
    )
    record = F.concat(head, "block").alias("value")
    for part, size in ((~tall, longest[0] or 0), (tall, longest[1])):
        if size is not None:
            most = max(1, min(RECORDS, MOST_BYTES // (size + 4096)))
            written = rows.where(part).withColumn("block", block).select(record)
            written.write.mode("append").option("lineSep", BREAK * 2).option("maxRecordsPerFile", most).text(path)


class Damage(ValueError):
    """A record that does not hold what it says."""


def _record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record at ``at``: where it ends, its header fields in lower case, and its payload."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Damage("header without end")
    fields: dict[str, str] = {}
    for line in data[version.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damage("no length")
    body, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        raise Damage("cut short")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("no end mark")
    payload = data[body:stop]
    if fields.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and fields.get("warc-type") != "revisit" and digest[5:] != payload_digest(payload):
        raise Damage("digest differs")
    return stop + 4, fields, payload


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(begin, end, fault, fields, payload) of all records and gaps of a plain stretch of records, in order.

    After a failed check the next version line is searched for, from just behind the failed one.  The
    bytes passed over are one gap: its fault says which check failed first.
    """
    at, lost, fault = 0, None, ""
    while at < len(data):
        try:
            end, fields, payload = _record(data, at)
        except Damage as why:
            if lost is None:
                lost, fault = at, str(why)
            found = _VERSION.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield lost, at, fault, {}, b""
            lost = None
        yield at, end, None, fields, payload
        at = end
    if lost is not None:
        yield lost, at, fault, {}, b""


def _before_fault(data: bytes, at: int, why: str) -> list[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Records and gaps of the part of a damaged gzip member that unpacks, a gap last; nothing if no record is left.

    Places are those of the steps (of STEP bytes, near the fault of one) in which a record or gap begins and ends; neighbours may share a step.
    Damage can change bytes before it is noticed, so records without a digest of their own payload, revisits too, count as lost.
    """
    unpack, parts, view, step = zlib.decompressobj(31), [], memoryview(data), STEP
    reached, sizes = [at], [0]
    while reached[-1] < len(data) and not unpack.eof:
        before = unpack.copy()
        try:
            parts.append(unpack.decompress(view[reached[-1] : reached[-1] + step]))
        except zlib.error:
            if step == 1:
                break
            unpack, step = before, 1  # the last step again, byte by byte
            continue
        reached.append(min(reached[-1] + step, len(data)))
        sizes.append(sizes[-1] + len(parts[-1]))
    rows = []
    for begin, end, wrong, fields, payload in salvage(b"".join(parts)):
        place = reached[bisect_right(sizes, begin) - 1], reached[bisect_left(sizes, end)]
        own = fields.get("warc-type") != "revisit" and fields.get("warc-payload-digest", "").startswith("sha1:")
        if wrong is None and own:
            rows.append((*place, None, fields, payload))
        elif rows and rows[-1][2]:
            rows[-1] = (rows[-1][0], place[1], *rows[-1][2:])
        else:
            rows.append((*place, wrong or "no digest in a damaged member", {}, b""))
    if all(wrong for _, _, wrong, *_ in rows):
        return []
    if rows[-1][2] is None:
        rows.append((rows[-1][1], rows[-1][1], why, {}, b""))
    return rows


def salvage_members(data: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """The same for files of gzip members, plain records or both, however they begin; places in members are those of the members.

    After a failed check the nearer of the next gzip member that unpacks to records and the next version line is searched for.
    Records of a damaged member that were unpacked before the fault are kept where their digests hold; the gap begins behind them.
    """
    at, lost, fault, line = 0, None, "", -1
    while at < len(data):
        packed = data.startswith(_GZIP, at)
        try:
            if packed:
                unpack = zlib.decompressobj(31)
                plain = unpack.decompress(memoryview(data)[at:]) + unpack.flush()
                if not unpack.eof:
                    raise Damage("member cut short")
                if lost is not None and not _VERSION.search(plain):
                    raise Damage("no version line")
                end = len(data) - len(unpack.unused_data)
                found = [(at, end, wrong, fields, payload) for _, _, wrong, fields, payload in salvage(plain)]
            else:
                end, fields, payload = _record(data, at)
                found = [(at, end, None, fields, payload)]
        except (zlib.error, Damage) as why:
            kept = _before_fault(data, at, str(why)) if packed else []
            if kept:
                if lost is not None:
                    yield lost, at, fault, {}, b""
                yield from kept[:-1]
                lost, fault = kept[-1][0], kept[-1][2]
            if lost is None:
                lost, fault = at, str(why)
            member = data.find(_GZIP, at + 1)
            if line <= at:
                version = _VERSION.search(data, at + 1)
                line = version.start() if version else len(data)
            at = line if member < 0 else min(member, line)
            continue
        if lost is not None:
            yield lost, at, fault, {}, b""
            lost = None
        yield from found
        at = end
    if lost is not None:
        yield lost, at, fault, {}, b""


SCHEMA = (
    "archive string, begin long, end long, fault string, record_type string, record_id string, target_uri string, "
    "payload_digest string, refers_to string, payload_bytes long, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*") -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, plain or gzip, one row each.

    A gap has its ``fault`` and byte range and nulls else; it never hides the records after it.  payload_digest and payload_bytes are
    those of the payload found, for revisits those their header names.  ``payloads=False`` leaves ``payload`` null.
    """

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                rows: list[tuple] = []
                held = 0
                for begin, end, fault, fields, payload in salvage_members(data):
                    if fault is not None:
                        rows.append((name.as_py(), begin, end, fault, *[None] * 7))
                    else:
                        known = fields.get("warc-type") == "revisit"
                        size = fields.get("x-payload-length", "") if known else str(len(payload))
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if known else payload_digest(payload)
                        rows.append(
                            (
                                name.as_py(), begin, end, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
                                digest or None, fields.get("warc-refers-to"), int(size) if size.isdigit() else None, payload if payloads else None,
                            )
                        )
                    held += len(payload) if payloads else 0
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content").mapInArrow(run, SCHEMA)


_KINDS = pa.schema(
    [("archive", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("fault", pa.string())]
    + [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=_KINDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives of all ``pages``.

    Null html is an empty payload; null urls have no target line; repeated rows give records of their own.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False, pattern="part-*").where("fault IS NULL")
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.regexp_extract(c, r"^<urn:ironlog:page:(.+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(kind)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_DIGITS = " || ".join(
    f"substr('{BASE32}', 1 + ((v{i // 4} >> {15 - 5 * (i % 4)}) & 31)::INT, 1)" for i in range(32)
)
_PARTS = ", ".join(f"('0x' || substr(sha1(t), {1 + 5 * j}, 5))::BIGINT AS v{j}" for j in range(8))

#: Base32 from hexadecimal digits, five at a time; payloads compared as whole texts.
ORACLE = f"""
WITH d AS (
  SELECT page_id, t, min(page_id) OVER (PARTITION BY t) AS first, {_PARTS}
  FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)
)
SELECT page_id, octet_length(encode(t)) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""
