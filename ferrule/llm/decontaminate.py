"""Benchmark decontamination by greedy string tiling.

Token runs (seeds) that documents and benchmark items share are joined; each candidate pair is then tiled: the longest common run of
unmarked tokens is marked, again and again, until none of at least `least` tokens is left. Matches are found from Karp-Rabin hashes of runs
of `least` tokens and lengthened. The part of an item's tokens under tiles is its coverage, whatever the order of the passages.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import NOT_ALNUM, bounded, cut, folders, map_arrow, remove, shingle_hashes, text_bytes, word_hashes

LEAST, COVERAGE = 5, 0.5
#: Seeds (8 bytes each) of a benchmark up to this many go to every task, which then sends on only what may join; with more, all seeds are joined.
BROADCAST_SEEDS = 2_000_000
#: Seeds with their items (60 bytes each) up to this many are broadcast to the documents' seeds; more meet them by a shuffle.
BROADCAST_ROWS = 500_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes: words of letters, digits and bytes above ASCII, A-Z lower-cased."""
    return word_hashes(*text_bytes(column), NOT_ALNUM)


#: Pairs of places that are looked at in one step.
PAIRS = 1 << 20


def _runs(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of `least` tokens or more (place in a, place in b, length). Equal hashes are found by binary search, some places of a at
    once, however often a run is repeated; hits next to each other on a diagonal are one run."""
    ha, _ = shingle_hashes(a, np.array([0, len(a)]), least)
    hb, _ = shingle_hashes(b, np.array([0, len(b)]), least)
    order = np.argsort(hb, kind="stable")
    low, high = (np.searchsorted(hb[order], ha, side) for side in ("left", "right"))
    at = np.flatnonzero(high > low)
    counts = (high - low)[at]
    ends = np.cumsum(counts)
    out, begin = [], 0
    while begin < len(at):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")), begin + 1)
        n = counts[begin:end]
        i = np.repeat(at[begin:end], n)
        j = order[np.repeat(low[at[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        same = np.ones(len(i), bool)
        for k in range(least):
            same &= a[i + k] == b[j + k]
        i, j = i[same], j[same]
        by = np.lexsort((i, i - j))
        i, j = i[by], j[by]
        if len(i):
            first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
            out.append(np.stack([i[first], j[first], np.diff(np.append(first, len(i)))], 1))
        begin = end
    if not out:
        return []
    # runs that a step has cut go on in the next
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
    diagonal = runs[:, 0] - runs[:, 1]
    new = np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (runs[1:, 0] != runs[:-1, 0] + runs[:-1, 2])])
    first = np.flatnonzero(new)
    return [(i, j, n + least - 1) for i, j, n in zip(runs[first, 0].tolist(), runs[first, 1].tolist(), np.add.reduceat(runs[:, 2], first).tolist())]


def tile(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length) of two token sequences, longest first; ties by the place in b, then in a."""
    if len(a) < least or len(b) < least:
        return []
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    heap = [(-n, j, i) for i, j, n in _runs(a, b, least)]
    heapq.heapify(heap)
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = free_a[i : i + n] & free_b[j : j + n]
        if free.all():
            free_a[i : i + n] = free_b[j : j + n] = False
            out.append((i, j, n))
            continue
        # what other tiles have taken splits the match; its free parts wait for their turn
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= least:
                heapq.heappush(heap, (x - y, j + x, i + x))
    return out


def _seed_rows(texts: DataFrame, least: int, coverage: float) -> DataFrame:
    """(item, seed, times, need) of the benchmark's distinct texts: how often a seed is in the item, and how many places of shared seeds the item
    needs at least: each tile has one or more, and `least` tokens of the coverage at most to each."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        words, ends = tokens(b.column(1))
        sh, at = shingle_hashes(words, ends, least)
        of = np.repeat(np.arange(b.num_rows), np.diff(at))
        sizes = np.diff(ends)
        whole = sizes[of] >= least  # shorter items have no tile
        need = np.ceil(coverage * sizes[of] / least - 1e-9).astype(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[whole])), pa.array(sh[whole].view(np.int64)), pa.array(need[whole])], ["item", "seed", "need"])

    return map_arrow(texts, fn, "item binary, seed long, need long").groupBy("item", "seed").agg(F.count(F.lit(1)).alias("times"), F.max("need").alias("need"))


def _digest(c: str):
    return F.unhex(F.sha2(F.col(c), 256))


def matches(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, coverage: float = COVERAGE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(digest, item_id, coverage, matched, tiles), a table in the shared folder: for each distinct document text (SHA-256 digest) and item whose coverage
    reaches the threshold, the tokens under tiles and the tiles (doc_at, item_at, length). Null texts count as empty; items of fewer than `least` tokens
    can't be matched; items with equal texts each have rows; null item ids stay null. Of tiles of equal length the first in the item, then in the
    text, comes first. Very long texts are tiled whole, in one task. Other columns don't matter; empty tables give no rows."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("item_text")).withColumn("item", _digest("item_text"))
    seeds = cut(_seed_rows(items.select("item", "item_text").dropDuplicates(["item"]), least, coverage), "seeds")
    known = None
    if seeds.count() <= broadcast_seeds:
        known = np.sort(seeds.select("seed").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        low = np.zeros(1 << 22, bool)
        low[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        low = np.packbits(low)
    else:
        low = None
    sent = docs.sparkSession.sparkContext.broadcast((known, low))

    def fn(b: pa.RecordBatch):
        known, low = sent.value
        sh, at = shingle_hashes(*tokens(b.column(0)), least)
        if known is not None:
            at_bit = (sh & np.uint64((1 << 22) - 1)).astype(np.int64)
            hit = np.flatnonzero(low[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8) & 1)
            hit = hit[np.isin(sh[hit], known)] if len(known) else hit[:0]
        else:
            hit = np.arange(len(sh))
        doc = np.searchsorted(at, hit, side="right") - 1
        rows = np.unique(doc)
        texts = b.column(0).take(pa.array(rows)).to_pylist()
        own = [np.unique(x).view(np.int64) for x in np.split(sh[hit], np.searchsorted(doc, rows[1:]))] if len(rows) else []
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts], pa.binary()), pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64()))], ["digest", "text", "seeds"])

    found = cut(map_arrow(docs.select(F.col(doc_text).alias("text")), fn, "digest binary, text string, seeds array<long>").dropDuplicates(["digest"]), "candidates")
    # a seed that many texts share meets its items where it is, if these are few
    met = found.select("digest", F.explode("seeds").alias("seed")).join(bounded(seeds, BROADCAST_ROWS), "seed")
    pairs = met.groupBy("digest", "item").agg(F.sum("times").alias("times"), F.max("need").alias("need")).filter("times >= need").select("digest", "item")

    def tiled(b: pa.RecordBatch) -> pa.RecordBatch:
        (x, xs), (y, ys) = tokens(b.column(2)), tokens(b.column(3))
        keep, part, n, spans = [], [], [], []
        for i in range(b.num_rows):
            got = tile(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], least)
            whole, under = int(ys[i + 1] - ys[i]), sum(t[2] for t in got)
            if got and under >= coverage * whole:
                keep.append(i)
                part.append(under / whole)
                n.append(under)
                spans.append([{"doc_at": t[0], "item_at": t[1], "length": t[2]} for t in got])
        kind = pa.list_(pa.struct([("doc_at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())]))
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(part, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, kind)], ["digest", "item", "coverage", "matched", "tiles"])

    both = pairs.join(found.select("digest", "text"), "digest").join(items.select("item", "item_text").dropDuplicates(["item"]), "item").select("digest", "item", "text", "item_text")
    hits = map_arrow(both, tiled, "digest binary, item binary, coverage double, matched long, tiles array<struct<doc_at: long, item_at: long, length: long>>")
    out = cut(hits.join(items.select("item", "item_id"), "item").select("digest", "item_id", "coverage", "matched", "tiles"), "hits")
    remove(docs.sparkSession, *folders(seeds), *folders(found))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, coverage, matched, n_tiles) for each row of docs and item; repeated rows have repeated results."""
    hits = matches(docs, benchmark, text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest_of_text(text).alias("digest"))
    return rows.join(hits, "digest").select("doc_id", "item_id", "coverage", "matched", F.size("tiles").alias("n_tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that cover no item, as they are."""
    hits = matches(docs, benchmark, text, **options).select("digest").distinct()
    return docs.join(hits, _digest_of_text(text) == hits["digest"], "left_anti")


def _digest_of_text(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
