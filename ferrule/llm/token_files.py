"""Token ids in binary files: frequency-ranked, byte-aligned variable-length integers with their control bytes apart.

A file is a row of blocks. A block: the magic bytes, the number of documents, of integers and of data bytes (unsigned 32-bit,
little-endian), for each document its id (signed 64-bit) and a byte that is 1 for a null id, for each its number of ids (unsigned 32-bit),
then the control bytes (two bits an integer: its length in bytes less one, four integers a byte, the first in the low bits), then the
data bytes, then END. The integers are ranks of ids by falling corpus frequency, so most take one byte. The rank table is a
Parquet table beside the files.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import bounded, cut, held, map_arrow, remove, scratch_dir, tokenizer_path
from ferrule.llm.pieces import LETTERS_FIRST, Memo, PartMemo, part_memo

VOCABULARY = "byte_bpe_50k.json"
MAGIC, END = b"FVB1", b"\nFVB.\n"
#: Integers after which a block is closed, and blocks of a file. A document is never split.
BLOCK_INTS, FILE_BLOCKS = 1 << 18, 64
#: Files (20 bytes each) whose totals are broadcast; those of more meet their documents by a shuffle.
BROADCAST_FILES = 1_000_000

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative integers below 2^32."""
    n = len(ranks)
    width = 2 if ranks.max(initial=0) <= 0xFFFF else 4
    x = np.zeros((n + 3) // 4 * 4, f"<u{width}")
    x[:n] = ranks
    code = (x > 0xFF).astype(np.uint8)
    if width == 4:
        code += (x > 0xFFFF).astype(np.uint8) + (x > 0xFFFFFF)
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    each = x[:n].view(np.uint8).reshape(-1, width)
    keep = np.arange(width) <= code[:n, None]
    return control.astype(np.uint8).tobytes(), each[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers; lengths come from a table with a row for each control byte."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    ids = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    null = bytes([i is None for i in doc_ids])
    return MAGIC + np.array([len(doc_ids), len(ranks), len(data)], "<u4").tobytes() + ids + null + counts.astype("<u4").tobytes() + control + data


def read_blocks(content: bytes):
    """For each block of a file: document ids (None for null), numbers of ids, ranks. A damaged file raises ValueError."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, n, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
        at += 16
        ids = np.frombuffer(content, "<i8", docs, at)
        null = content[at + 8 * docs : at + 9 * docs]
        counts = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        control = content[at : at + (n + 3) // 4]
        at += len(control)
        ranks = unpack(control, content[at : at + size], n)
        at += size
        if content[at : at + len(END)] != END:
            raise ValueError(f"a block doesn't end at byte {at}")
        at += len(END)
        yield [None if z else int(i) for i, z in zip(ids, null)], counts, ranks


def _byte_letters() -> dict[str, str]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 ones for themselves, the others from U+0100 on (a fixed rule)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return str.maketrans({chr(b): chr(0x100 + k) for k, b in enumerate(rest)})


def _tokenizer(path: str) -> PartMemo:
    """Pre-tokens go straight to the library's model, which is half the time of its whole chain for a short string. The model doesn't know added
    tokens: texts that hold the string of one (`added`) must go through the whole chain (`keep`)."""
    gc.disable()  # the memos hold no cycles, and walking them is costly
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    kind, letters, model = "H" if t.get_vocab_size() <= 1 << 16 else "I", _byte_letters(), t.model

    blank, char = letters[ord(" ")], Memo(lambda c: c.encode().decode("latin-1").translate(letters), 10_000)

    def piece(p: str) -> bytes:
        # printable ASCII stands for itself, but for the blank
        own = p.replace(" ", blank) if p.isascii() and p.isprintable() else "".join([char[c] for c in p])
        return array(kind, [x.id for x in model.tokenize(own)]).tobytes()

    memo = part_memo(LETTERS_FIRST, piece, 350_000)
    memo.kind, memo.keep, memo.added = "<u2" if kind == "H" else "<u4", t, [x.content for x in t.get_added_tokens_decoder().values()]
    return memo


def text_ids(t: PartMemo, text: str) -> bytes:
    """A text's ids as the library's encode without special tokens of its own gives them: added tokens in the text count as such."""
    if any(x in text for x in t.added):
        return np.array(t.keep.encode(text, add_special_tokens=False).ids, t.kind).tobytes()
    return b"".join(t.values(text))


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, n, ids, counts): a row for each document with its ids (little-endian, 16 bits each where the vocabulary allows, else 32) and
    the end id after them; and rows with only counts: how often a batch has each id. Null and empty texts have the end id alone."""
    path = path or tokenizer_path(VOCABULARY)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        t = held(("tokenizer", path), lambda: _tokenizer(path))
        end = np.array([end_id], t.kind).tobytes()
        rows = [text_ids(t, x or "") + end for x in b.column(1).to_pylist()]
        width = len(end)
        counts = np.bincount(np.frombuffer(b"".join(rows), t.kind)).astype("<i8").tobytes() if rows else None
        return pa.RecordBatch.from_arrays(
            [pa.array([*b.column(0).to_pylist(), None], pa.int64()), pa.array([*[len(r) // width for r in rows], 0], pa.int64()), pa.array([*rows, None], pa.binary()), pa.array([*[None] * len(rows), counts], pa.binary())],
            ["doc_id", "n", "ids", "counts"],
        )

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), fn, "doc_id long, n long, ids binary, counts binary", holds=True)


def _sum_counts(df: DataFrame) -> DataFrame:
    """(id, n) from rows of counts; each task adds its own first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                x = np.frombuffer(c, "<i8")
                if len(x) > len(total):
                    total = np.concatenate([total, np.zeros(len(x) - len(total), np.int64)])
                total[: len(x)] += x
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    return df.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> None:
    """Writes the files under out/blocks in ascending doc_id order (nulls first; ties by length, then ids; file names sort in that order)
    and the rank table under out/ranks. Repeated rows stay. A very long text is a block of its own, never cut. Other columns don't matter, whatever their names. An empty input
    makes empty folders' worth of files.

    The only rows that reach the driver are the vocabulary's."""
    spark = docs.sparkSession
    path = path or tokenizer_path(VOCABULARY)
    tokens = cut(tokenize(docs, doc_id, text, path, end_id), "tokens")
    kind = "<u2" if _vocabulary_size(path) <= 1 << 16 else "<u4"
    counts = _sum_counts(tokens.filter(F.col("counts").isNotNull()).select("counts")).toPandas().sort_values(["n", "id"], ascending=[False, True])
    ranked = counts["id"].to_numpy(np.int64)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranked)), "id": ranked}), "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{out}/ranks")
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def run(batches):
        ids, counts, raws, held, width = [], [], [], 0, int(kind[-1])

        def block():
            return pa.RecordBatch.from_arrays([pa.array([block_bytes(ids, np.array(counts), rank_of[np.frombuffer(b"".join(raws), kind)])], pa.binary())], ["block"])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                ids.append(doc)
                counts.append(len(raw) // width)
                raws.append(raw)
                held += counts[-1]
                if held >= BLOCK_INTS:
                    yield block()
                    ids, counts, raws, held = [], [], [], 0
        if ids:
            yield block()

    order = ["doc_id", "n", "ids"]
    rows = tokens.filter(F.col("ids").isNotNull()).select("doc_id", "n", "ids")
    dealt = rows.repartitionByRange("doc_id", "n").sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))  # the cast keeps the bytes
    blocks.write.mode("overwrite").option("lineSep", END.decode()).option("maxRecordsPerFile", FILE_BLOCKS).text(f"{out}/blocks")
    remove(spark, tokens.inputFiles()[0].rsplit("/", 1)[0]) if tokens.inputFiles() else None


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


_PART = re.compile(r"part-(\d+)-.*?-c(\d+)")


def read(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of written files with their ids (little-endian unsigned 32-bit) and how many ids come
    before, counted over all files in the order of their names."""
    table = spark.read.parquet(f"{out}/ranks").toPandas().sort_values("rank")["id"].to_numpy(np.uint32)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part, piece = map(int, _PART.search(name).groups())
                start = 0
                for docs, counts, ranks in read_blocks(content):
                    ids, ends = table[ranks].astype("<u4"), np.cumsum(counts.astype(np.int64))
                    begins = ends - counts
                    raw = ids.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), part)), pa.array(np.full(len(docs), piece)), pa.array(begins + start), pa.array(counts.astype(np.int64)), pa.array([raw[4 * x : 4 * y] for x, y in zip(begins, ends)], pa.binary())],
                        ["doc_id", "part", "piece", "within", "n_tokens", "ids"],
                    )
                    start += int(ends[-1]) if len(ends) else 0

    def sizes(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, at = 0, 0
                while at < len(content):
                    docs, ints, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
                    n, at = n + ints, at + 16 + 13 * docs + (ints + 3) // 4 + size + len(END)
                part, piece = map(int, _PART.search(name).groups())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int64()), pa.array([n], pa.int64())], ["part", "piece", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/blocks").select("path", "content")
    docs = files.mapInArrow(run, "doc_id long, part long, piece long, within long, n_tokens long, ids binary")
    # a row for each file: small enough to be summed in one task
    totals = files.mapInArrow(sizes, "part long, piece long, n long")
    from pyspark.sql import Window

    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return docs.join(bounded(before, BROADCAST_FILES), ["part", "piece"]).select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids")


def new_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "tokenfiles")
