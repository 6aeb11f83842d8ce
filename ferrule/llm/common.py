"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if its files come in fewer partitions than there are cores, as one small file does; all steps on texts are bound by CPU."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a session whose tasks run in the driver's own
    process may use the driver's temporary folder; on a cluster that would be another folder on each machine, so it's refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/ferrule-scratch"
    return f"{base.rstrip('/')}/ferrule-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim_executors(spark: SparkSession) -> None:
    """Lets each executor collect its garbage, by a job of two tasks for each core, so that heap that earlier steps have grown goes back to the system
    before a step whose Python workers need the room."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).filter("done is not null").write.format("noop").mode("overwrite").save()


#: Rows that a function of map_arrow sees at once.
SLICE, SLICE_BYTES = 1024, 1 << 20


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, SLICE):
        todo = [b.slice(k, SLICE)]
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > SLICE_BYTES:
                half = x.num_rows // 2
                todo += [x.slice(half), x.slice(0, half)]
            else:
                yield x


_HELD: dict[object, object] = {}
#: The C library's function that returns free memory, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks, such as memos. Only one key's value is kept, as Spark uses a worker for one stage after another."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Frees what is held, and gives the system back what earlier tasks of this worker have freed."""
    if _HELD:
        _HELD.clear()
        gc.unfreeze()
        gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: Rows of the batches that Spark hands to Python workers where the session doesn't set their number (10,000 are Spark's own): of long texts
#: more would take some hundred MB in the executor beside its heap.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | T.StructType, holds: bool = False) -> DataFrame:
    """mapInArrow with a function of one batch. Spark's batches (64 MB at most by default) are handed over in slices of at most SLICE rows and
    SLICE_BYTES, or of one row that is larger. Functions that use held() say so; the others' tasks begin by freeing what is held."""

    def run(batches):
        if not holds:
            forget()
        for whole in batches:
            for part in slices(whole):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        if holds:
            gc.freeze()  # Spark's workers collect garbage after each task, and would walk all that is held

    spark = df.sparkSession
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one buffer and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df doesn't have (names clash without regard to case)."""
    have = {c.lower() for c in df.columns}
    while want.lower() in have:
        want = "_" + want
    return want


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(p: int, n: int) -> np.ndarray:
    """p^0 .. p^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(p, k, 1 << 64))
        k += m
    return out


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BLOCK = 1 << 22
_UP = _DOWN = np.ones(1, np.uint64)
#: Spaces of the words [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: As _SPACE, and all other ASCII but letters and digits.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each text after A-Z are lower-cased, and each text's first word's place
    (n+1 offsets). `spaces` says which bytes part words. Words don't cross texts. A word's hash is a polynomial of its bytes modulo 2^64, from prefix sums, finalised."""
    global _UP, _DOWN
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = spaces[raw]
    first = np.zeros(n, bool)
    inner = offsets[1:-1]
    first[inner[inner < n]] = True
    prev_space = np.empty(n, bool)
    prev_space[0] = True
    prev_space[1:] = space[:-1]
    starts = np.flatnonzero(~space & (prev_space | first))
    ends_here = np.empty(n, bool)
    ends_here[-1] = True
    ends_here[:-1] = space[1:] | first[1:]
    ends = np.flatnonzero(~space & ends_here) + 1
    if len(_UP) < n + 1:
        _UP, _DOWN = _powers(_P, n + 1), _powers(_P_INV, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * _UP[:n], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order (a text of 1 to k-1 words gives its whole sequence as one), and n+1 offsets."""
    counts = np.diff(at)
    n_sh = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n_sh)])
    total = int(out_at[-1])
    if not total:
        return np.zeros(0, np.uint64), out_at
    doc = np.repeat(np.arange(len(counts)), n_sh)
    pos = at[:-1][doc] + (np.arange(total) - out_at[:-1][doc])
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = counts[doc] < k
    with np.errstate(over="ignore"):
        for j in range(k):
            term = padded[pos + j] * np.uint64((0xA24BAED4963EE407 * (2 * j + 1)) & (2**64 - 1))
            if short.any():
                term = np.where(short & (j >= counts[doc]), np.uint64(0), term)
            h = mix64(h + term + np.uint64(j + 1))
        if short.any():
            h = np.where(short, mix64(h + counts[doc].astype(np.uint64)), h)
    return h, out_at


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary file is. FERRULE_TOKENIZERS, if set, names another folder."""
    if folder := os.environ.get("FERRULE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows; else as it is, and Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


#: Edges (16 bytes each) up to this many are joined into components by one task; more by rounds of shuffles.
ONE_TASK_EDGES = 1_000_000


def components(edges: DataFrame, name: str = "components", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes of the edges (a, b) other than roots, as a table in the shared folder.
    Up to `one_task` edges go through one task; more through alternating large-star and small-star steps, each written to the
    shared folder; a logarithmic number of them. Self-loops and repeated edges don't matter."""
    spark = edges.sparkSession
    first = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, mark = cut(first, name), None
    if stars.count() <= one_task:
        roots = cut(stars.repartition(1).mapInArrow(_union, "node long, root long"), name)
        remove(spark, *folders(stars))
        return roots
    while True:
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        new = cut(small, name)
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        old, stars = stars, new
        remove(spark, *folders(old))
        if now == mark:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (u, v) of a task: least neighbours are taken over and paths halved until nothing changes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])


def folders(df: DataFrame) -> list[str]:
    """The folders of the files that df reads."""
    return list({f.rsplit("/", 1)[0] for f in df.inputFiles()})
