"""WARC archives: pages to records with segments and chunked transfer, and back to payloads.

Writing: every page is an HTTP response record, its payload in chunked transfer framing. Blocks longer than ``segment``
bytes are cut: the first part stays in the record, the rest follows in continuation records that name their origin and
their segment number, the last one also the total length. Records with a payload that another record holds already are
revisits and carry headers only. Archives are plain files of bounded size below one folder of the shared store, written
and read by Spark's own sources; gzip members are read as well.

Reading: records are parsed by their Content-Length, never by searching for marks, so payloads may hold anything.
Continuations are grouped by the identifier of their origin and ordered by segment number; a record is whole if its
segments run from 1 without gaps or contradictions and their lengths add up to the stated total. Only records in
several segments are shuffled. HTTP heads are split off and chunks (with extensions and trailers) are decoded.
Revisits get size and page from the response with their digest.

Nulls: a null html is an empty payload, a null url gives no target, a null page_id no page header; null page_ids count
as the largest. Rows that repeat are records of their own; of equal payloads all rows with the smallest page_id are
responses. Segments that arrive twice count once. A record that is not whole has a null payload and ``whole`` false;
continuations without their first segment belong to no response.
Empty tables give an empty folder and no records. Only the named columns of the input are used.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.frames import table, written
from folioflow.llm.registry import query
from folioflow.llm.skew import join_groups
from folioflow.session import scratch_path

#: Bytes of a block in one record, bytes of a chunk, records in a file, payloads below which nothing is a revisit.
SEGMENT, CHUNK, FILE_RECORDS, LEAST = 16_384, 8_192, 2_048, 100
#: Any instant would do; a fixed one keeps archives of the same pages equal.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "id string, kind string, page_id long, target string, digest string, segment int, origin string, total long, block binary"


# ---- writing


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = []
    for lo in range(0, len(payload), size):
        part = payload[lo : lo + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _head(kind: str, name: str, length: int, page_id: int | None, target: str | None, *more: tuple[str, object]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if target is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", target))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"{k}: {v}" for k, v in more]
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + END


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, seen: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that close it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    about = ("WARC-Payload-Digest", f"sha256:{digest}")
    if seen:
        yield _head("revisit", name, len(http), page_id, url, ("WARC-Profile", PROFILE), about) + http
        return
    block = http + chunked(payload)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment:
        yield _head("response", name, len(block), page_id, url, kind, about) + block
        return
    yield _head("response", name, segment, page_id, url, kind, about, ("WARC-Segment-Number", 1)) + block[:segment]
    for n, lo in enumerate(range(segment, len(block), segment), 2):
        part = block[lo : lo + segment]
        more = [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", n)]
        if lo + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _head("continuation", f"{name}:{n}", len(part), page_id, url, *more) + part


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Digest of each payload (columns page_id, url, html) and ``first_id``, the page whose response a revisit refers to."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256))
    shared = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = written(shared.filter("n > 1 and first_id is not null"), "warc-shared")
    rows = join_groups(rows, shared, "digest", "n")
    return rows.withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST, records: int = FILE_RECORDS) -> None:
    """Write pages (page_id, url, html) as WARC files of at most ``records`` records of at most ``segment`` bytes each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            columns = [batch.column(k) for k in range(5)]
            columns[2] = columns[2].cast(pa.binary())
            for page_id, url, html, digest, first_id in zip(*(c.to_pylist() for c in columns)):
                n += 1
                for record in page_records(f"urn:page:{page_id}:{part}:{n}", page_id, url, html, digest, first_id is not None, segment):
                    out.append(record)
                    size += len(record)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = with_first(pages, least).select("page_id", "url", "html", "digest", "first_id").mapInArrow(pack, "record binary")
    # The text source writes the bytes as they are; its line end is what closes a record.
    lines = rows.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(path)


# ---- reading


def members(data: bytes) -> bytes:
    """The contents of a file of gzip members; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out += [one.decompress(data), one.flush()]
        data = one.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    data = memoryview(members(data))
    whole, at = data.obj, 0
    while (end := whole.find(END, at)) >= 0:
        head = whole[at:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        length = fields.get("content-length", "")
        if not head[0].startswith("WARC/") or not length.isdecimal():
            raise ValueError(f"no WARC record at byte {at}")
        at = end + 4 + int(length)
        if at > len(data):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(data[end + 4 : at])
        at += 4


def _bare(field: str | None) -> str | None:
    return field and field.strip("<>")


def _number(field: str | None) -> int | None:
    return int(field) if field and re.fullmatch(r"-?\d+", field) else None


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """One row for each record of the archives below ``path``; of all, or only those (not) in several segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
            names = [c.split(" ")[0] for c in RECORDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    number = _number(f.get("warc-segment-number"))
                    if segmented is not None and segmented != (number is not None):
                        continue
                    name = _bare(f.get("warc-record-id"))
                    origin = name if number == 1 else _bare(f.get("warc-segment-origin-id"))
                    digest = (f.get("warc-payload-digest") or "").rpartition(":")[2].lower() or None
                    total = _number(f.get("warc-segment-total-length"))
                    rows.append((name, f.get("warc-type"), _number(f.get("x-page-id")), f.get("warc-target-uri"), digest, number, origin, total, block))
                    size += len(block)
                    if size > 4_000_000:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Records in several segments as one each: the columns of the first segment, whole block or null, and ``whole``."""
    # A segment that was read twice counts once; two that contradict each other leave the record incomplete.
    parts = F.array_sort(F.array_distinct(F.collect_list(F.struct("segment", "block"))))
    first = F.first(F.when(F.col("segment") == 1, F.struct("id", "kind", "page_id", "target", "digest")), ignorenulls=True)
    sums = records.groupBy("origin").agg(first.alias("f"), parts.alias("p"), F.min("total").alias("low"), F.max("total").alias("high"))
    numbers = F.transform("p", lambda x: x["segment"])
    length = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    whole = (numbers == F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1)))) & (F.col("low") == F.col("high")) & (F.col("high") == length)
    rows = sums.withColumn("whole", F.coalesce(whole, F.lit(False)))
    # Bytes joined by way of hex digits: concat takes no array.
    digits = F.array_join(F.transform("p", lambda x: F.hex(x["block"])), "")
    block = F.when(F.col("whole"), F.unhex(digits))
    return rows.select(F.coalesce("f.id", "origin").alias("id"), "f.kind", "f.page_id", "f.target", "f.digest", "whole", block.alias("block"))


def unchunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            # Trailer fields may follow; they are no part of the payload.
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response: what follows its head, without transfer framing."""
    head, mark, body = block.partition(END)
    fields = dict(line.lower().partition(":")[::2] for line in head.decode("latin-1").split("\r\n")[1:])
    return unchunked(body) if mark and "chunked" in fields.get("transfer-encoding", "") else body


def payloads(records: DataFrame, keep: bool = True) -> DataFrame:
    """Response records (id, page_id, target, digest, whole, block) with size and digest of the payload, and with ``keep`` the payload.

    ``whole`` also turns false where the framing is broken or the payload has not the digest its record states.
    """
    # The digest is taken where the bytes are; without ``keep`` they go no further.
    schema = "id string, page_id long, target string, digest string, whole boolean, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for lo in range(0, len(batch), 512):
                rows = []
                for r in batch.slice(lo, 512).to_pylist():
                    payload = http_payload(r["block"]) if r["whole"] else None
                    digest = None if payload is None else hashlib.sha256(payload).hexdigest()
                    whole = payload is not None and r["digest"] in (None, digest)
                    size = None if payload is None else len(payload)
                    rows.append((r["id"], r["page_id"], r["target"], r["digest"], whole, size, digest, payload if keep else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return records.select("id", "page_id", "target", "digest", "whole", "block").mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """Responses and revisits below ``path``: id, page_id, target, payload_bytes, payload_digest, record_type, refers_to, whole, payload.

    A revisit refers to the smallest page with a response of its digest and takes its size; without one it is not whole.
    """
    single = read_records(spark, path, segmented=False)
    parts = reassemble(read_records(spark, path, segmented=True)).filter("kind = 'response'").drop("kind")
    plain = single.filter("kind = 'response'").withColumn("whole", F.lit(True)).select(parts.columns)
    # Sizes and digests are written once: the answers to revisits start from them.
    found = payloads(plain.unionByName(parts), keep)
    found = written(found, "warc-responses") if keep else written(found.drop("payload"), "warc-responses").withColumn("payload", F.lit(None).cast("binary"))
    revisits = written(single.filter("kind = 'revisit'").select("id", "page_id", "target", F.col("digest").alias("payload_digest")), "warc-revisits")
    sizes = revisits.groupBy("payload_digest").agg(F.count("*").alias("n"))
    holds = found.filter("whole").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    answers = written(sizes.join(holds, "payload_digest"), "warc-answers")
    linked = join_groups(revisits, answers, "payload_digest", "n")
    columns = ["id", "page_id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole", "payload"]
    responses = found.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    linked = linked.withColumns({"record_type": F.lit("revisit"), "whole": F.col("payload_bytes").isNotNull(), "payload": F.lit(None).cast("binary")})
    return responses.select(columns).unionByName(linked.select(columns))


SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by sha256(h)) as least_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id is distinct from least_id and least_id is not null then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from least_id then least_id end as refers_to
from d
"""


@query("op13_warc", SQL)
def op13(spark, sf_dir):
    """Every page through archives and back."""
    path = scratch_path(spark, "llm-warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
