"""Media columns: payloads are kept as 8-bit sound, cut where their content says, and each distinct chunk is stored once.

A payload becomes a WAVE file of 8-bit samples. A rolling gear hash over its bytes cuts it: a cut falls where the hash of the last 32 bytes
has zeros under a mask, but not before the least length, and at the greatest at the latest. The manifest of a file is its ordered
list of chunk digests; files with the same manifest are one medium. Digests are counted by a Spark aggregation. A chunk that occurs once is
stored in a row with the other such chunks of its medium; each of the others is shuffled by its digest and stored once. To read a medium its
list is joined with the chunks by digest, and they are put in the list's order and verified; only media without a shared chunk need no join.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import _BYTE, cut, folders, map_arrow, release_shuffles, remove

#: Bytes of a chunk at least and at most, and zeros that a cut needs: a chunk has some 768 bytes on average.
LEAST, GREATEST, MASK_BITS = 256, 8 << 10, 9
RATE = 8000
_GEAR = (_BYTE >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash (h * 2 + table[byte], 32 bits) after each byte. A byte's part is shifted out after 32 more, so the hash is a sum over
    a window, made by doubling."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h = more
    return h


def cuts(media: bytes, least: int = LEAST, greatest: int = GREATEST, bits: int = MASK_BITS) -> list[int]:
    """Where chunks end. Files of up to `least` bytes are one chunk."""
    n = len(media)
    if n <= least:
        return [n] if n else []
    mask = np.uint32(((1 << bits) - 1) << (32 - bits))
    at = (np.flatnonzero((gear(np.frombuffer(media, np.uint8)) & mask) == 0) + 1).tolist()
    out, begin, k = [], 0, 0
    while n - begin > least:
        while k < len(at) and at[k] < begin + least:
            k += 1
        end = min(at[k] if k < len(at) else n, begin + greatest, n)
        out.append(end)
        begin = end
    if begin < n:
        out.append(n)
    return out


def to_wave(payload: bytes) -> bytes:
    """A WAVE file of 8-bit mono samples (fixed format values); a payload of odd length gets the format's fill byte at the end."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def from_wave(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
    return media[at + 8 : at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]]


def features(payload: bytes) -> str:
    """Of the samples: mean, root mean square about 128, zero crossings about 128, and the most frequent value."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    if not len(x):
        return "0;0;0;0"
    return f"{x.mean() + 128:.4f};{np.sqrt((x.astype(np.float64) ** 2).mean()):.4f};{int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};{int(np.bincount(x + 128).argmax())}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (64 if not raw else -len(raw) % 64), len(raw)


#: Digests that occur more than once, up to this many (8 bytes of each), are told to every task; with more, all chunks are deduplicated by a shuffle.
TOLD_DIGESTS = 2_000_000
CHUNK = "digest binary, data binary"
#: Chunks are written once and take most of the disk, so they are compressed harder than at zstandard's usual level 3.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false"}
PACK = "medium binary, list array<binary>, chunks array<binary>, common int"


def pieces(text: str | None) -> tuple[int, list[bytes], list[bytes]]:
    """The payload's length without padding, and the chunks of its sound and their digests."""
    payload, n = padded(text)
    media, begin, chunks = to_wave(payload), 0, []
    for end in cuts(media):
        chunks.append(media[begin:end])
        begin = end
    return n, chunks, [hashlib.sha256(c).digest() for c in chunks]


def medium_of(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).digest()


def _manifest(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, medium_of(digests), digests) for n, _, digests in map(pieces, b.column(1).to_pylist())]
        n, medium, chunks = zip(*rows)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(medium, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "medium", "chunks"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), fn, "doc_id long, n_bytes long, medium binary, chunks array<binary>")


def _packs(docs: DataFrame, text: str, told: np.ndarray | None) -> DataFrame:
    """(medium, list, chunks, common): with common 0 for each text the chunks that no other has, in order, and, if it has others too, the list of these
    ones' digests, with a null in place of each of its own; with common 1 the chunks that may occur again, each once a batch."""
    sent = docs.sparkSession.sparkContext.broadcast(told)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        known, seen = sent.value, {}
        got = [pieces(t)[1:] for t in b.column(0).to_pylist()]
        digests = [d for _, own in got for d in own]
        if known is None:
            again = np.ones(len(digests), bool)
        else:
            heads = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            again = known[np.minimum(np.searchsorted(known, heads), len(known) - 1)] == heads if len(known) else np.zeros(len(digests), bool)
        flags, rows, copies = iter(again.tolist()), [], set()
        for chunks, own in got:
            have, order = [], []
            for c, d, common in zip(chunks, own, flags):
                order.append(d if common else None)
                if common:
                    seen[d] = c
                else:
                    have.append(c)
            medium = medium_of(own)
            if len(have) == len(own):
                rows.append((medium, None, have, 0))
            elif have or medium not in copies:
                copies.add(medium)
                rows.append((medium, order, have, 0))
        if seen:
            rows.append((None, None, list(seen.values()), 1))
        kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], [], []), kinds)], ["medium", "list", "chunks", "common"])

    return map_arrow(docs.select(F.col(text).alias("text")), fn, PACK)


def _heads(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(d[:8] for d in b.column(0).to_pylist()), np.int64))], ["head"])


def store(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes out/manifest (doc_id, n_bytes, medium, chunks: digests in order), out/packs (medium, chunks: those that occur once, in order; list: the
    digests of the others in order, if there are any, with nulls between for those) and out/kept (digest, data: each chunk that occurs again, once).

    Null and empty texts are a payload of 64 zero bytes. Repeated rows and null ids have rows of their own in the manifest, and share the
    medium. A very long text is one row, in one task. Other columns of docs don't matter, whatever their names; an empty table gives empty ones.
    Digests are counted by a shuffle of digests only; then the texts are cut again (keeping their sound meanwhile would take as much disk as the
    store), chunks that occur once go straight to the store, and only those that occur again are shuffled, to keep one of each."""
    spark = docs.sparkSession
    _manifest(docs, doc_id, text).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/manifest")
    counts = spark.read.parquet(f"{out}/manifest").select(F.explode("chunks").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    heads = cut(map_arrow(counts.filter("c > 1").select("digest"), _heads, "head long").distinct(), "again")
    told = np.sort(heads.toArrow().column(0).to_numpy()) if heads.count() <= TOLD_DIGESTS else None
    _packs(docs, text, told).write.mode("overwrite").partitionBy("common").options(**STORED).parquet(f"{out}/packs")
    raw = spark.read.schema(PACK).parquet(f"{out}/packs").filter("common = 1").select(F.explode("chunks").alias("data")).select(F.unhex(F.sha2("data", 256)).alias("digest"), "data")
    kept = raw.groupBy("digest").agg(F.first("data").alias("data"))
    kept.write.mode("overwrite").options(**STORED).parquet(f"{out}/kept")
    remove(spark, f"{out}/packs/common=1", *folders(heads))
    release_shuffles(spark)  # before chunks are joined to their lists


def read(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The manifest (doc_id, n_bytes, medium) and the media (medium, media, payload, feature), one for each distinct manifest, reconstructed from the
    chunks in the order of its list and verified: each chunk against its digest, the list against the medium's. A missing or damaged chunk raises
    ValueError. Shared chunks come by a join of the lists with their digests, and are gathered with the medium's own, at most one document's at once."""
    manifest = spark.read.parquet(f"{out}/manifest")
    packs = spark.read.schema(PACK).parquet(f"{out}/packs").filter("common = 0")
    kept = spark.read.schema(CHUNK).parquet(f"{out}/kept")
    alone = packs.filter("list is null").select("medium", "list", "chunks")
    parted = packs.filter("list is not null")
    # a medium with a chunk of its own has one row
    single = parted.filter("size(chunks) > 0").select("medium", "list", "chunks")
    copied = parted.filter("size(chunks) = 0").groupBy("medium").agg(F.first("list").alias("list"))
    lists = single.select("medium", "list").unionAll(copied)
    shared = lists.select("medium", F.explode(F.array_distinct(F.filter("list", lambda d: d.isNotNull()))).alias("digest")).join(kept, "digest").select("medium", "data")
    gathered = shared.groupBy("medium").agg(F.collect_list("data").alias("shared"))
    none = F.array().cast("array<binary>")
    wanted = single.unionAll(copied.withColumn("chunks", none)).join(gathered, "medium", "left")
    return manifest.select("doc_id", "n_bytes", "medium"), _rebuild(alone.withColumn("shared", none).unionAll(wanted))


def _rebuild(parts: DataFrame) -> DataFrame:
    """Rows are handed on some hundred at once, or fewer where they are large."""

    def fn(b: pa.RecordBatch):
        rows, held = [], 0
        for medium, order, chunks, shared in zip(*[c.to_pylist() for c in b.columns]):
            by, own = {hashlib.sha256(data).digest(): data for data in shared or ()}, [(hashlib.sha256(data).digest(), data) for data in chunks]
            lost = [d for d in order or () if d is not None and d not in by]
            if lost:
                strange = by.keys() - set(order)
                raise ValueError(f"chunk {lost[0].hex()} is {'damaged' if strange else 'missing'}")
            by |= dict(own)
            if order is None:  # no chunk is shared, so they are stored in order
                order = [d for d, _ in own]
            elif order.count(None) != len(own):
                raise ValueError(f"medium {medium.hex()} is not whole: a chunk is missing or damaged")
            else:
                each = iter(own)
                order = [next(each)[0] if d is None else d for d in order]
            if medium_of(order) != medium:
                raise ValueError(f"medium {medium.hex()} is not whole: a chunk is missing or damaged")
            payload = from_wave(media := b"".join(by[d] for d in order))
            rows.append((medium, media, payload, features(payload)))
            held += len(media)
            if len(rows) >= 256 or held >= 1 << 20:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.binary(), pa.binary(), pa.string()))], ["medium", "media", "payload", "feature"])

    return map_arrow(parts, fn, "medium binary, media binary, payload binary, feature string")
