"""Exact Jaccard self-join of word shingles by parity sketches.

A pair of linked sets differs in at most d shingles, where d follows from the threshold and the sizes of a band. Each set is dealt by hash into
m > d cells, and a cell holds the XOR of its shingles' hashes. A shingle that only one of two sets has changes one cell, so a set
with more than d non-empty cells has one at least in common with each partner (pigeonhole): cells are the keys of an equi-join. A parity bit
sketch, whose Hamming distance is also at most the symmetric difference, prunes what meets by chance; an exact check on the shingle hashes
(64 bits) decides.

Groups aren't expanded into pairs. A key whose documents already belong to one component needs nothing. A key with at most PARTNERS pairs of
different components for each of its documents is compared directly. Each key carries its set's size and a folded sketch, so that most of what can't
be linked never becomes a pair. Others (hot keys: groups of near copies, shared passages) are
compared with one document in turn and linked ones merged. A key that stays hot may be left out for a set which has more than d non-empty
cells that aren't hot, as one of those is shared with each partner. Only sets without that are dealt again, with each shingle as a cell of
its own; and those of which at most d shingles aren't hot once more, by their hot shingles alone, with as many cells as their
other shingles leave to differ. There the last groups are compared inside a join whose condition has sizes, rests and sketches. Each key carries
the least keys of its set, and two sets become a pair only at keys below which those show no common one: nearly always at one key of all they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import bounded, components, cut, folders, forget, map_arrow, mix64, release_shuffles, remove, shingle_hashes, text_bytes, word_hashes

BAND, SPARE = 1.6, 1.3
#: Pairs for each document of a key up to which it is compared directly.
PARTNERS = 4
#: Ids (16 bytes each) up to this many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shared keys (8 bytes each) up to this many are told to every task; with more, all keys are joined by a shuffle.
TOLD_KEYS = 4_000_000
#: Keys that one step of looking for shared ones holds, about.
BUCKET_KEYS = 1 << 19
#: Of a set's keys in the third deal the least so many tell where it has met another before.
LEAST = 16
EVERY, HOT = 1 << 16, 1 << 17  # the seeds of the second and third deal


class Bands:
    """Size bands: band s has smaller partners of low[s] to low[s+1]-1 shingles; d[s] bounds the symmetric difference."""

    def __init__(self, num: int, den: int, count: int = 60):
        if not (den > 0 and 10 * num >= 7 * den and num <= den):
            raise ValueError("the threshold must be from 0.7 to 1: below it a band's sets may differ in as many shingles as the smallest of them has")
        self.num, self.den, self.low, self.high, self.d = num, den, [1], [], []
        for _ in range(count):
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))
        for s in range(count):
            a = self.low[s + 1] - 1
            b = a * den // num
            self.high.append(b)
            self.d.append((den - num) * (a + b) // (den + num))

    def of(self, n: int) -> list[int]:
        return [s for s in range(len(self.d)) if self.low[s] <= n <= self.high[s]]


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n+1 offsets."""
    sh, at = shingle_hashes(*word_hashes(*text_bytes(column)), k)
    out = [np.unique(sh[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _tag(band: int, seed: int) -> np.uint64:
    return mix64(np.array([(band << 20) + seed + 1], np.uint64))[0]


def _cells(h: np.ndarray, doc: np.ndarray, m: int, band: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty ones of m cells of each document, by document, with the documents they're of."""
    tag = _tag(band, seed)
    mixed = mix64(h ^ tag)
    cell = doc.astype(np.int64) * m + (mixed % np.uint64(m)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity = np.bitwise_xor.reduceat(mixed[order], begin)
    of, no = cell[begin] // m, (cell[begin] % m).astype(np.uint64)
    return mix64(parity + mix64(no + tag)), of


def _cell_number(d: int) -> int:
    return int(np.ceil(SPARE * d)) + 1


def _every(h: np.ndarray, band: int) -> np.ndarray:
    """Keys of the second deal: one for each shingle."""
    return mix64(h ^ _tag(band, EVERY))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity bits of a set's hashes, as signed 64-bit words, of one to two bits a shingle. The Hamming distance of two of one length is at
    most the size of the symmetric difference. One of twice the length becomes one of this by XOR of its halves."""
    words = 4
    while 64 * words < len(h):
        words *= 2
    odd = np.bincount((mix64(h) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_link(num: int, den: int) -> str:
    """SQL: sizes (na, nb) and sketches (sa, sb) allow a link. Sizes that do so are near, so sketches differ by one doubling at most."""
    half = lambda x, y: f"CASE WHEN size({x}) > size({y}) THEN zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q) ELSE {x} END"
    far = f"aggregate(zip_with({half('sa', 'sb')}, {half('sb', 'sa')}, (p, q) -> bit_count(p ^ q)), 0, (x, y) -> x + y)"
    return f"{den} * least(na, nb) >= {num} * greatest(na, nb) AND {den + num} * {far} <= {den - num} * (na + nb)"


#: Of a set what its keys carry: its size, and its sketch folded to 128 bits.
BRIEF = "brief struct<n: long, f0: long, f1: long>"


def _brief(n: str, sk: str) -> str:
    """SQL: the brief of a set of size n with the sketch sk."""
    fold = lambda k: f"aggregate(filter({sk}, (x, i) -> i % 2 = {k}), 0L, (x, y) -> x ^ y)"
    return f"named_struct('n', {n}, 'f0', {fold(0)}, 'f1', {fold(1)}) AS brief"


def _briefs(sets: list[np.ndarray]) -> pa.Array:
    folds = [np.bitwise_xor.reduce(sketch(x).reshape(-1, 2), axis=0) for x in sets]
    flat = np.concatenate([np.zeros((0, 2), np.int64), *[f[None] for f in folds]])
    return pa.StructArray.from_arrays([pa.array([len(x) for x in sets], pa.int64()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["n", "f0", "f1"])


def _briefly(num: int, den: int) -> str:
    """SQL: briefs (ba, bb) allow a link. A folded sketch's distance is at most the sketch's."""
    return f"{den} * least(ba.n, bb.n) >= {num} * greatest(ba.n, bb.n) AND {den + num} * (bit_count(ba.f0 ^ bb.f0) + bit_count(ba.f1 ^ bb.f1)) <= {den - num} * (ba.n + bb.n)"


def _side(sigs: DataFrame, x: str) -> DataFrame:
    return sigs.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}"))


def _unit(digest: bytes, band: int) -> int:
    """A set in a band: a hash with the band in its low byte."""
    return int.from_bytes(digest[:7], "little", signed=True) << 8 | band


def _longs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, sk, units): the size, digest and sketch of each row's set, and for each of its bands (unit, spare: how many non-empty
    cells are more than may differ, keys: of the cells)."""
    bands = Bands(num, den)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        h, at = _sets(b.column(1), k)
        sizes = np.diff(at)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        each = [h[at[i] : at[i + 1]] for i in range(len(sizes))]
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in each]
        rows = []
        for s in range(len(bands.d)):
            there = (sizes >= bands.low[s]) & (sizes <= bands.high[s])
            if bands.d[s] and there.any():  # sets that may not differ at all have no partners but their copies
                pick = there[doc]
                keys, of = _cells(h[pick], doc[pick], _cell_number(bands.d[s]), s)
                got, first, full = np.unique(of, return_index=True, return_counts=True)
                rows += [(i, _unit(digests[i], s), f - bands.d[s], keys[x : x + f]) for i, x, f in zip(got.tolist(), first.tolist(), full.tolist())]
        rows.sort(key=lambda r: r[:2])
        keys = _longs(np.concatenate([np.zeros(0, np.uint64), *[r[3] for r in rows]]), np.array([len(r[3]) for r in rows], np.int64))
        inner = pa.StructArray.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), keys], ["unit", "spare", "keys"])
        ends = np.concatenate([[0], np.cumsum(np.bincount([r[0] for r in rows], minlength=len(sizes)))]).astype(np.int32)
        sk = [sketch(x) for x in each]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(digests, pa.binary()), _longs(np.concatenate([np.zeros(0, np.int64), *sk]), np.array([len(x) for x in sk])), pa.ListArray.from_arrays(pa.array(ends), inner)], ["doc_id", "n", "digest", "sk", "units"])

    return map_arrow(docs, fn, "doc_id long, n long, digest binary, sk array<long>, units array<struct<unit: long, spare: int, keys: array<long>>>")


class Join:
    """One run: the tables it wrote, the links found so far and the components they make."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, partners: int, told: int):
        self.spark, self.docs, self.k, self.num, self.den, self.partners, self.told = docs.sparkSession, docs, k, num, den, partners, told
        self.bands, self.written, self.tried = Bands(num, den), [], None
        self.sigs = self.keep(signatures(docs, k, num, den), "sigs")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        self.written += folders(out)
        return out

    def clean(self, but: DataFrame) -> None:
        stay = set(folders(but))
        remove(self.spark, *[f for f in self.written if f not in stay])

    def link(self, edges: DataFrame) -> None:
        self.edges = edges
        self.roots = components(edges)
        self.written += folders(self.roots)

    # keys that at least two rows have

    def shared(self, units: DataFrame, about: int | None = None) -> DataFrame:
        """(key, doc_id, brief, unit, spare) of keys that more than one of the units (doc_id, brief, unit, spare, keys) has; about: how many keys there are."""
        about = units.select(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] if about is None else about
        met = self.keep(self._met(units.select("keys"), about), "met")
        n = met.count()
        if n > self.told:
            rows = units.select(F.explode("keys").alias("key"), "doc_id", "brief", "unit", "spare").join(met, "key")
        else:
            known = np.sort(met.toArrow().column(0).to_numpy())
            sent = self.spark.sparkContext.broadcast(known)
            rows = map_arrow(units.select("keys", "doc_id", "brief", "unit", "spare"), lambda b: _only(b, sent.value), f"key long, doc_id long, brief {units.schema['brief'].dataType.simpleString()}, unit long, spare int")
        return self.keep(rows, "shared")

    def _met(self, keys: DataFrame, about: int) -> DataFrame:
        """Each key that occurs twice or more. Tasks sort out their own keys first and send on each once, so a common one comes once from each."""
        buckets = max(4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), about // BUCKET_KEYS)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            held, n = [], 0
            for b in batches:
                x = b.column(0)
                held.append(x.flatten().to_numpy().view(np.uint64))
                n += len(held[-1])
                if n >= BUCKET_KEYS:
                    yield packed(np.concatenate(held))
                    held, n = [], 0
            if n:
                yield packed(np.concatenate(held))

        def packed(x: np.ndarray) -> pa.RecordBatch:
            x, c = np.unique(x, return_counts=True)
            bucket = ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending with x
            ids, first = np.unique(bucket, return_index=True)
            one = [y.tobytes() for y in np.split(x, first[1:])]
            many = [y[z > 1].tobytes() for y, z in zip(np.split(x, first[1:]), np.split(c, first[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(one, pa.binary()), pa.array(many, pa.binary())], ["bucket", "one", "many"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            at, held = None, []
            for b in batches:
                for bucket, one, many in zip(*[c.to_pylist() for c in b.columns]):
                    if bucket != at and held:
                        yield found(held)
                        held = []
                    at = bucket
                    held.append((np.frombuffer(one, np.uint64), np.frombuffer(many, np.uint64)))
                    if sum(len(x) + len(y) for x, y in held) > 4 * BUCKET_KEYS:  # what is known to be shared needs to be held once
                        x, c = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
                        held = [(x, np.unique(np.concatenate([x[c > 1], *[y for _, y in held]])))]
            if held:
                yield found(held)

        def found(held) -> pa.RecordBatch:
            x, c = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([x[c > 1], *[y for _, y in held]])).view(np.int64))], ["key"])

        dealt = keys.mapInArrow(deal, "bucket long, one binary, many binary")
        return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "key long")

    # comparing

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b): those that sizes and sketches allow, by the whole texts of both."""
        sigs, num, den, k = self.sigs.filter("n > 0 and doc_id is not null"), self.num, self.den, self.k
        pairs = self.keep(pairs.join(_side(sigs, "a"), "a").join(_side(sigs, "b"), "b").filter(_may_link(num, den)).select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = self.keep(self.docs.join(bounded(ids, BROADCAST_IDS), "doc_id", "left_semi"), "texts")

        def fn(b: pa.RecordBatch):
            for k0 in range(0, b.num_rows, 128):
                part = b.slice(k0, 128)
                (ha, at), (hb, bt) = _sets(part.column(2), k), _sets(part.column(3), k)
                keep = []
                for i in range(part.num_rows):
                    x, y = ha[at[i] : at[i + 1]], hb[bt[i] : bt[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

        side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
        links = self.keep(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb"), fn, "a long, b long").distinct(), "links")
        remove(self.spark, *folders(texts))
        return links

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with the component of their document."""
        roots = bounded(self.roots.withColumnRenamed("node", "doc_id"), BROADCAST_IDS)
        return rows.join(roots, "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")

    def settle(self, rows: DataFrame, rounds: tuple[int, ...], first_rank=None) -> DataFrame:
        """Links the documents that share a key of rows (key, doc_id, brief, unit, spare); gives the rows of keys that stay hot. rounds: of each, how many pairs
        for a document a key may have to be compared directly; the others are compared with one of their documents. Only sets whose briefs allow a
        link become a pair."""
        may = _briefly(self.num, self.den)
        for turn, partners in enumerate(rounds):
            rows = self.named(rows)
            part = lambda seed: F.sum(F.pmod(F.xxhash64("doc_id", "brief", F.lit(seed)), F.lit(1 << 28))).alias(f"h{seed}")
            groups = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"), F.min("doc_id").alias("lo"), part(1), part(2))
            keys = groups.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("s"), F.min("lo").alias("lo"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).filter("comps > 1")
            keys = self.keep(keys.withColumn("hot", F.expr(f"g * g - s > {2 * partners} * g")), "keys")
            # keys with the same sets would give the same pairs
            cool = keys.filter("not hot").groupBy("g", "lo", "h1", "h2").agg(F.min("key").alias("key")).select("key")
            few = rows.join(cool, "key").select("key", "doc_id", "comp", "brief")
            x, y = few.toDF("key", "a", "ca", "ba"), few.toDF("key", "b", "cb", "bb")
            pairs = x.join(y, "key").filter(f"a < b AND ca <> cb AND {may}").select("a", "b")
            hot = keys.filter("hot").select("key")
            hot_rows = rows.join(bounded(hot, BROADCAST_IDS), "key", "left_semi")
            rank = first_rank if first_rank is not None and not turn else F.xxhash64("comp", F.lit(turn)) if turn else F.lit(0).cast("long")
            centre = hot_rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "doc_id", "comp", "brief")).alias("c")).select("key", F.col("c.doc_id").alias("c"), F.col("c.comp").alias("cc"), F.col("c.brief").alias("bb"))
            stars = hot_rows.withColumnRenamed("brief", "ba").join(centre, "key").filter(f"comp <> cc AND {may}").select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b"))
            self.compare(pairs.unionAll(stars).distinct())
            rows = self.keep(hot_rows.drop("comp"), "hot")
            if rows.isEmpty():
                break
        return self.active(rows)

    def compare(self, pairs: DataFrame) -> None:
        pairs = self.keep(pairs, "met-pairs")
        if pairs.isEmpty():
            return
        new = pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti")
        links = self.verify(new)
        self.tried = pairs if self.tried is None else self.tried.unionAll(pairs)
        if not links.isEmpty():
            self.link(self.edges.unionAll(links))

    def active(self, rows: DataFrame) -> DataFrame:
        """The rows of keys that are still in several components."""
        if rows.isEmpty():
            return rows
        named = self.named(rows)
        open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return self.keep(named.join(bounded(open_keys, BROADCAST_IDS), "key", "left_semi").drop("comp"), "open")

    # the second and the third deal

    def unsure(self, hot: DataFrame, units: DataFrame) -> DataFrame:
        """(doc_id, unit) with too few cells that aren't hot."""
        by_hot = hot.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("h"), F.min("spare").alias("spare")).filter("h >= spare").select("doc_id", "unit")
        return by_hot.unionAll(units.filter("spare <= 0").select("doc_id", "unit")).distinct()

    def every(self, unsure: DataFrame) -> DataFrame:
        """The units' second deal (doc_id, brief, unit, spare, keys)."""
        k, bands = self.k, self.bands
        per = unsure.groupBy("doc_id").agg(F.collect_set("unit").alias("units"))
        rows = self.docs.join(bounded(per, BROADCAST_IDS), "doc_id").select("doc_id", "text", "units")

        def fn(b: pa.RecordBatch):
            h, at = _sets(b.column(1), k)
            out = []
            for i, units in enumerate(b.column(2).to_pylist()):
                x = h[at[i] : at[i + 1]]
                digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                out += [(i, u, len(x) - bands.d[u & 255], _every(x, u & 255), x) for u in sorted(units) if _unit(digest, u & 255) == u]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in out], pa.int64())), _briefs([r[4] for r in out]), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), _longs(np.concatenate([np.zeros(0, np.uint64), *[r[3] for r in out]]), np.array([len(r[3]) for r in out], np.int64))], ["doc_id", "brief", "unit", "spare", "keys"])

        return self.keep(map_arrow(rows, fn, f"doc_id long, {BRIEF}, unit long, spare int, keys array<long>").dropDuplicates(["doc_id", "unit"]), "every")

    def by_hot(self, hot: DataFrame) -> DataFrame:
        """The third deal (doc_id, brief, unit, spare, keys) of units of which at most d shingles aren't hot; spare says how many less than d. Briefs
        also have the least of the unit's keys."""
        bands = self.bands
        units = hot.groupBy("doc_id", "unit").agg(F.collect_set("key").alias("hot"), F.min("spare").alias("least"), F.min("brief").alias("brief")).filter("size(hot) >= least")
        units = units.select("doc_id", "brief", "unit", (F.size("hot") - F.col("least")).alias("room"), "hot")

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            keys = []
            for unit, room, hot in zip(*[b.column(c).to_pylist() for c in (2, 3, 4)]):
                band, q = unit & 255, np.array(hot, np.int64).view(np.uint64)
                own = []
                # partners meet at the level of that with less room
                for level in range(1, 5):
                    may = -(-level * bands.d[band] // 4)
                    full, seed = 0, HOT + (level << 8)
                    while full <= may:
                        x, _ = _cells(q, np.zeros(len(q), np.int64), _cell_number(may) << (seed & 255), band, seed)
                        own.append(x)
                        full, seed = len(x), seed + 1
                    if may >= room:
                        break
                keys.append(np.concatenate(own))
            least = [np.unique(x.view(np.int64))[:LEAST] for x in keys]
            brief = pa.StructArray.from_arrays([*b.column(1).flatten(), _longs(np.concatenate([np.zeros(0, np.int64), *least]), np.array([len(x) for x in least], np.int64))], ["n", "f0", "f1", "least"])
            return pa.RecordBatch.from_arrays([b.column(0), brief, b.column(2), b.column(3).cast(pa.int32()), _longs(np.concatenate([np.zeros(0, np.uint64), *keys]), np.array([len(x) for x in keys], np.int64))], ["doc_id", "brief", "unit", "spare", "keys"])

        return self.keep(map_arrow(units, fn, f"doc_id long, {BRIEF[:-1]}, least: array<long>>, unit long, spare int, keys array<long>"), "by-hot")

    def meeting(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of sets that share a key of rows and may link. The shingles that aren't hot are no one else's, so those of both count as
        differences. Of all keys that two sets share the least always makes them a pair (a cool one has done so before), and a greater one only where
        the least keys that they carry show none in common below it."""
        d = F.element_at(F.array(*[F.lit(x) for x in self.bands.d]), (F.col("unit").bitwiseAND(255) + 1).cast("int"))
        sigs = self.sigs.filter("n > 0 and doc_id is not null").select("doc_id", "n", "sk").distinct()
        full = self.named(rows).withColumn("d", d).join(sigs, "doc_id")
        x, y = (full.select("key", F.col("doc_id").alias(s), F.col("comp").alias(f"c{s}"), F.col("spare").alias(f"r{s}"), F.col("d").alias(f"d{s}"), F.col("n").alias(f"n{s}"), F.col("sk").alias(f"s{s}"), F.col("brief.least").alias(f"l{s}")) for s in "ab")
        first = "coalesce(array_min(array_intersect(la, lb)), key) >= key"
        return x.join(y, "key").filter(f"a < b AND ca <> cb AND ra + rb >= da AND {_may_link(self.num, self.den)} AND {first}").select("a", "b")

    def rest(self, rows: DataFrame) -> None:
        """Compares all that share a key inside the join."""
        self.compare(self.meeting(rows).distinct())


def _only(b: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
    """A row for each key that is known."""
    keys = b.column(0)
    counts = np.diff(keys.offsets.to_numpy())
    flat = keys.flatten().to_numpy()
    at = np.searchsorted(known, flat)
    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == flat) if len(known) else np.zeros(0, np.int64)
    of = pa.array(np.repeat(np.arange(b.num_rows), counts)[hit])
    return pa.RecordBatch.from_arrays([pa.array(flat[hit]), *[c.take(of) for c in b.columns[1:]]], ["key", *b.schema.names[1:]])


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5, partners: int = PARTNERS, told: int = TOLD_KEYS) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs: the size of its set of k-word shingles, and the smallest doc_id reachable by
    links, itself included. Two documents link when den * intersection >= num * union; num / den must be from 0.7 to 1.

    Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; a text of fewer than k words has its whole sequence as one shingle. Null texts and
    texts without words have an empty set and no links. Rows with the same doc_id are one document that has each of their links. A null
    doc_id has no links and a null component. Ties of similarity link; very long texts are one row in one task; other columns don't matter. No row
    gives no row."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = Join(plain, k, num, den, partners, told)
    whole = run.sigs.filter("n > 0 and doc_id is not null")
    # equal sets: one row stands for each
    sets = whole.select("doc_id", "digest")
    firsts = sets.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "first")
    firsts = bounded(run.keep(firsts, "firsts"), BROADCAST_IDS)
    same = run.keep(sets.join(firsts, "digest").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), "digest").distinct(), "same")
    run.link(same.select("a", "b"))
    # of an id with several texts only those that are copies are left out
    copies = bounded(same.select(F.col("b").alias("doc_id"), "digest"), BROADCAST_IDS)
    units = whole.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", F.expr(_brief("n", "sk")), F.explode("units").alias("u")).select("doc_id", "brief", "u.*")
    shared = run.shared(units, whole.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    release_shuffles(run.spark)
    # at first one document of each group takes most of it together
    hot = run.settle(shared, (1, partners, partners))
    unsure = run.keep(run.unsure(hot, units), "unsure")
    if not unsure.isEmpty():
        every = run.every(unsure)
        hot = run.settle(run.shared(every), (partners, partners))
        if not hot.isEmpty():
            left = run.settle(run.shared(run.by_hot(hot)), (partners,), first_rank=-F.col("spare"))
            if not left.isEmpty():
                run.rest(left)
    out = run.sigs.select("doc_id", F.col("n").alias("n_shingles"))
    out = cut(run.named(out).select("doc_id", "n_shingles", F.col("comp").alias("component_id")), "jaccard")
    run.clean(out)
    return out
