import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import media, url_filter, warc
from ferrule.llm.queries import QUERIES

from .common import TEXTS, documents

PAGES = [(3, "http://A.net/x", "<p>one</p>"), (1, "http://b.org/fr/", "<p>one</p>"), (2, None, "<p>one</p>"), (1, "u", "<p>one</p>"), (4, "u\r\nX: y", None), (5, "u", ""), (None, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "é\r\n\r\nWARC/1.1\r\n"), (9, "u", "x" * 200_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, SIZE int")


def test_warc_round_trip(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write(pages(spark), out)
    got = warc.read(spark, out).collect()
    assert len(got) == len(PAGES)
    firsts = {}
    for i, _, h in PAGES:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    expected = []
    for i, _, h in PAGES:
        raw, first = (h or "").encode(), firsts.get(h or "")
        revisit = first is not None and first != i
        expected.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(repr, expected)) == sorted(repr((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    assert len({r["record_id"] for r in got}) == len(PAGES) and [r["url"] for r in got if r["page_id"] == 4] == ["u%0D%0AX: y"]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    heads = [h for h, _ in warc.parse(whole)]  # plain gzip and WARC
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(PAGES) and all(h["warc-type"] == "revisit" and ids[h["warc-refers-to"]]["x-page-id"] == h["x-refers-to-page-id"] for h in heads if "warc-refers-to" in h)
    assert sum("warc-refers-to" in h for h in heads) == 1  # page 5 to 4; page 1 is there twice
    warc.write(pages(spark).limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    warc.write(pages(spark), f"file://{tmp_path}/least", least=100)
    assert {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/least").collect()} == {"response"}


def test_shuffled_heads_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PACK", 100)
    own = []
    for n in (10**6, 0):
        monkeypatch.setattr(warc, "BROADCAST_HEADS", n)
        warc.write(pages(spark), f"file://{tmp_path}/{n}")
        own.append(sorted(repr(tuple(r)[:7]) for r in warc.read(spark, f"file://{tmp_path}/{n}").collect()))
    assert own[0] == own[1] and len(own[0]) == len(PAGES)


def test_members_do_not_hold_the_separator():
    for raw in (b"x", warc.SEPARATOR * 50, "".join(map(chr, np.random.default_rng(0).integers(0, 9000, 9000))).encode()):
        assert warc.SEPARATOR not in warc.member(raw) and b"".join(warc.members(warc.member(raw) * 2)) == raw * 2
    with pytest.raises(ValueError):
        list(warc.members(warc.member(b"abc")[:-3]))
    with pytest.raises(ValueError):
        list(warc.members(b"abc"))


def test_damaged_archives():
    for bad in (b"x", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


URLS = ["http://EXAMPLE.net/en/a", "https://x.example.net/en", "http://net/", "http://net", "http://a.b.net:80/", "http://notnet/", "ftp://w.example.com/de/?q", "http://example.com/de", "http://example.org/fr/#f", "http://org/fr/x/y", None, "", "example.net/en/", "://", "http:///x", "http://ÀÉ.net/É?x://y", "http://a.net?x/y"]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut : next((k for k, c in enumerate(rest) if c in "?#"), len(rest))] if cut <= next((k for k, c in enumerate(rest) if c in "?#"), len(rest)) else ""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    from ferrule.llm.queries import URL_RULES

    df = spark.createDataFrame([(i % 5, u, "h", "v") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "v")], "page_id long, url string, HOST string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(df, rules)
    assert got.columns == ["page_id", "url", "HOST", "verdict", "_host", "path", "rule", "_verdict"]
    assert sorted(repr((r["_host"], r["path"], r["rule"], r["_verdict"])) for r in got.collect()) == sorted(repr(brute_verdict(u, URL_RULES)) for u in [*URLS, URLS[0]])
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["_verdict"] for r in url_filter.judge(df, rules.limit(0), default="block").collect()} == {"block"}


def test_shuffled_rules_give_the_same(spark, monkeypatch):
    from ferrule.llm.queries import URL_RULES

    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    one = sorted(map(repr, url_filter.judge(df, rules).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(repr, url_filter.judge(df, rules).collect())) == one


def test_gear_hash_is_the_rolling_one():
    raw = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, out = 0, []
    for b in raw.tolist():
        h = (h * 2 + int(media._GEAR[b])) % 2**32
        out.append(h)
    assert media.gear(raw).tolist() == out


def test_cuts_follow_content():
    r = np.random.default_rng(2)
    a = r.integers(0, 256, 400_000).astype(np.uint8).tobytes()
    for data in (b"", b"x", a[:40_000], a):
        ends = media.cuts(data)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(data) and all(s <= media.GREATEST for s in sizes) and all(s >= media.LEAST for s in sizes[:-1])
    one = lambda d: {d[x:y] for x, y in zip([0, *media.cuts(d)], media.cuts(d))}
    assert one(a) & one(b"some bytes in front" + a)
    assert media.cuts(b"\0" * 300_000)[-1] == 300_000


def edited(seed, n=40):
    """Texts of some KiB and near copies of them: a word changed, put in or taken out, or a passage of another in between."""
    r = random.Random(seed)
    words = lambda k: [f"w{r.randrange(5000)}" for _ in range(k)]
    passage, out = words(400), []
    for i in range(n):
        base = words(r.choice([3, 150, 900, 3000]))
        near = base[:]
        near[r.randrange(len(near))] = "changed"
        out += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(near)), (4 * i + 2, " ".join(base[: len(base) // 2] + passage + base[len(base) // 2 :])), (4 * i + 3, " ".join(base))]
    return out


@pytest.mark.parametrize("told", [10**6, 0])
def test_media_columns(spark, tmp_path, monkeypatch, told):
    """All columns of the query, read back from the chunks, against what the texts give."""
    monkeypatch.setattr(media, "TOLD_DIGESTS", told)
    rows = TEXTS + [(100 + i, t) for i, t in edited(3)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_media_chunks"](spark, str(tmp_path)).collect()
    expected = []
    for i, t in rows:
        payload, n = media.padded(t)
        wave = media.to_wave(payload)
        centred = [b - 128 for b in payload]
        crossings = sum((x >= 0) != (y >= 0) for x, y in zip(centred, centred[1:]))
        counts = Counter(payload)
        feature = f"{sum(centred) / len(payload) + 128:.4f};{(sum(x * x for x in centred) / len(payload)) ** 0.5:.4f};{crossings};{min(counts, key=lambda b: (-counts[b], b))}"
        expected.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave), hashlib.sha256(wave).hexdigest(), feature))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)


def test_near_copies_share_chunks(spark, tmp_path):
    """Each distinct chunk is stored once, lists have several, and near copies share most of theirs."""
    rows, out = edited(4), f"file://{tmp_path}/m"
    media.store(documents(spark, rows), out)
    manifest = {r["doc_id"]: r["chunks"] for r in spark.read.parquet(f"{out}/manifest").collect()}
    stored = [hashlib.sha256(c).digest() for r in spark.read.parquet(f"{out}/packs").collect() for c in r["chunks"]] + [r["digest"] for r in spark.read.parquet(f"{out}/kept").collect()]
    assert len(stored) == len(set(map(bytes, stored))) and set(map(bytes, stored)) == {bytes(d) for x in manifest.values() for d in x}
    assert len([d for x in manifest.values() for d in x]) > 5 * len(rows)
    long = [i for i, x in manifest.items() if i % 4 == 0 and len(x) > 20]
    assert long and all(len({*map(bytes, manifest[i])} & {*map(bytes, manifest[i + k])}) >= 0.6 * len(manifest[i]) for i in long for k in (1, 2))


def test_lists_hold_the_digests_of_shared_chunks_only(spark, tmp_path):
    """The others' can be had from the chunks beside the list."""
    rows, out = edited(5, 10), f"file://{tmp_path}/m"
    media.store(documents(spark, rows), out)
    packs = [r for r in spark.read.schema(media.PACK).parquet(f"{out}/packs").collect() if r["list"] is not None]
    kept = {bytes(r["digest"]) for r in spark.read.parquet(f"{out}/kept").collect()}
    assert any(r["chunks"] for r in packs) and all(r["list"].count(None) == len(r["chunks"]) and {bytes(d) for d in r["list"] if d is not None} <= kept for r in packs)
    assert sorted(bytes(r["payload"]) for r in media.read(spark, out)[1].collect()) == sorted({media.padded(t)[0] for _, t in rows})


def test_media_without_rows(spark, tmp_path):
    media.store(documents(spark).limit(0), f"file://{tmp_path}/none")
    assert [x.count() for x in media.read(spark, f"file://{tmp_path}/none")] == [0, 0]


@pytest.mark.parametrize("copies", [1, 2])
def test_missing_and_damaged_chunks_are_told(spark, tmp_path, copies):
    out, text = f"file://{tmp_path}/m", "a" * 30_000 + "b" * 9_900
    media.store(documents(spark, [(i, text) for i in range(copies)]), out)
    _, whole = media.read(spark, out)
    assert [bytes(r["payload"]) for r in whole.collect()] == [media.padded(text)[0]]
    kept = [(bytes(r["digest"]), bytes(r["data"])) for r in spark.read.parquet(f"{out}/kept").collect()]
    spark.createDataFrame(kept[1:], media.CHUNK).write.mode("overwrite").parquet(f"{out}/kept")
    with pytest.raises(Exception, match="is missing"):
        media.read(spark, out)[1].collect()
    spark.createDataFrame([(kept[0][0], b"x"), *kept[1:]], media.CHUNK).write.mode("overwrite").parquet(f"{out}/kept")
    with pytest.raises(Exception, match="is damaged"):
        media.read(spark, out)[1].collect()
