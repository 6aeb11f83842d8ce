"""WARC archives with revisits: headers are shuffled by payload digest; payloads only where more digests repeat than are broadcast.

Each record is a gzip member of its own, so it can be reached singly. Members are gathered into rows of about PACK bytes, which Spark's text sink
writes; its separator is an empty gzip member, which adds nothing to what the file decompresses to, and by which the text source splits
files again: readers hold one row at a time, and any file system that Spark knows will do.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import cut, map_arrow, scratch_dir

CRLF = "\r\n"
#: Bytes of records that a row of an archive gathers, and rows of a file.
PACK, FILE_ROWS = 1 << 20, 256
#: An empty gzip member, between rows.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated digests up to this many (some 30 MB) are broadcast to the payloads; more meet them by a shuffle.
BROADCAST_HEADS = 500_000


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1. Five hexadecimal digits are four of base 32."""
    h = F.sha1(data)
    fives = [F.lpad(F.translate(F.conv(F.substring(h, k, 5), 16, 32), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 4, "A") for k in range(1, 41, 5)]
    return F.concat(*fives)


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to, known, original_known): a record for each row. Of records with equal payloads of at least `least`
    bytes, those with the smallest page_id are originals and the others refer to it; rows that repeat that page_id are originals too. A null page_id
    is greater than all others: where a group has only null ones, all its records are originals. Null payloads are empty ones; null URLs stay null.
    known: no other row has this page_id and payload; original_known: the same of the original. Very long payloads are one row in one task; an empty
    table gives no rows; other columns don't matter, whatever their names."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"size": F.length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    same = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("c"), F.min("size").alias("size"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "c")))
    heads = same.groupBy("digest").agg(F.sum("c").alias("n"), first.alias("first"), F.collect_list(F.when(F.col("c") > 1, F.col("page_id"))).alias("repeated"), F.min("size").alias("size")).filter("n > 1")
    heads = cut(heads.select(F.col("digest").alias("_digest"), F.when(F.col("size") >= least, F.col("first.page_id")).alias("first"), F.col("first.c").alias("times"), "repeated"), "heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
    out = rows.join(heads, rows["digest"] == heads["_digest"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    known = F.col("page_id").isNotNull() & ~F.coalesce(F.array_contains("repeated", F.col("page_id")), F.lit(False))
    return out.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "size", "digest", refers.alias("refers_to"), known.alias("known"), F.coalesce(F.col("times") == 1, F.lit(False)).alias("original_known"))


def _known_id(page_id: int, digest: str) -> uuid.UUID:
    """The id of the one record of a page with this payload; revisits can tell it too."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, known: bool, original_known: bool, date: str) -> bytes:
    """A response record, whose block is an HTTP head and the payload, or a revisit without a block."""
    revisit = refers_to is not None
    block = b"" if revisit else f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode() + payload
    rid = _known_id(page_id, digest) if known else uuid.uuid4()
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": date, "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size}
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if revisit:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": refers_to}
        if original_known:
            head["WARC-Refers-To"] = f"<urn:uuid:{_known_id(refers_to, digest)}>"
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return f"WARC/1.1{CRLF}{''.join(f'{k}: {v}{CRLF}' for k, v in head.items())}{CRLF}".encode() + block + 2 * CRLF.encode()


def member(raw: bytes) -> bytes:
    """A gzip member without the bytes of the separator in it. They aren't UTF-8, so no text stored as it is holds them; compressed bits
    that happen to are compressed otherwise."""
    return next(x for x in (gzip.compress(raw, level, mtime=0) for level in (6, 5, 4, 3, 2, 1, 9)) if SEPARATOR not in x)


def write(pages: DataFrame, out: str, date: str | None = None, **names) -> None:
    """Writes WARC/1.1 files: a response or revisit record for each row. Every record has fresh headers: an id that no other has, the date (default:
    now, UTC), digest, length; revisits say what page they refer to, and its record's id unless rows repeat that page."""
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolve(pages, **names)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        packs, held = [], 0
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if not packs or held >= PACK:
                packs.append([])
                held = 0
            packs[-1].append(member(record(*row, date)))
            held += len(row[2])
        return pa.RecordBatch.from_arrays([pa.array([b"".join(p) for p in packs], pa.binary())], ["value"])

    archive = map_arrow(rows, fn, "value binary").select(F.col("value").cast("string").alias("value"))  # the cast keeps the bytes
    archive.write.mode("overwrite").option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).text(out)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record; a damaged file raises ValueError."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        size = int(head["content-length"])
        block = content[at : at + size]
        at += size
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record doesn't end at byte {at}")
        at += 4
        yield head, block


def members(raw: bytes) -> Iterator[bytes]:
    """What each gzip member holds; cut or damaged ones raise ValueError."""
    while raw:
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(raw)
        except zlib.error as e:
            raise ValueError(f"a member is damaged: {e}") from e
        if not z.eof:
            raise ValueError("a member is cut off")
        raw = z.unused_data
        yield out


def read(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id) of the records of written files. A response's length and
    digest are computed from the block read and must be the headers'; a revisit has a null payload, and its original's length and digest."""
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for pack in b.column(0).to_pylist():
            for raw in members(pack):
                for head, block in parse(raw):
                    own = head["warc-type"] == "response"
                    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if own else None
                    if own and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the block of {head['warc-record-id']} isn't what its headers say")
                    ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                    rows.append((ids[0], head["warc-target-uri"], payload, size, digest, head["warc-type"], ids[1], head["warc-record-id"]))
                    held += len(block)
                    if len(rows) >= 256 or held >= PACK:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    archive = spark.read.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(out).select(F.col("value").cast("binary").alias("value"))
    return map_arrow(archive, fn, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def new_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "warc")
