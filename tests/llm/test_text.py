import random
import zlib

import numpy as np
import pytest

from ferrule.llm import decontaminate, licenses, ngram_join, toxicity
from ferrule.llm.common import components, shingle_hashes, word_hashes

from .common import TEXTS, documents

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in SPACES:
            out += [now] * bool(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, num, den):
    sets, root = {}, {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and any(x & y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(seed, groups=12, size=9):
    """Texts that differ in some words from one another, of many lengths, with a passage that many share."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage, out = [r.choice(vocabulary) for _ in range(55)], []
    for g in range(groups):
        n = r.choice([1, 2, 4, 5, 6, 8, 12, 20, 40, 90, 300])
        base = [r.choice(vocabulary) for _ in range(n)] + passage * (g % 3 == 0)
        for _ in range(size):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, max(1, n // 40), max(1, n // 20)])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("seed,k,num,den", [(1, 4, 85, 100), (2, 5, 4, 5)])
def test_jaccard_components_lose_no_link(spark, seed, k, num, den):
    rows = near_copies(seed)
    got = ngram_join.jaccard_components(documents(spark, rows), k=k, num=num, den=den).collect()
    expected = brute_components(rows, k, num, den)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, k)) for i, t in rows}
    assert 10 < len(set(expected.values())) < len(rows) - 10


def test_jaccard_edge_cases(spark):
    got = ngram_join.jaccard_components(documents(spark), k=4, num=85, den=100).collect()
    assert len(got) == len(TEXTS)
    expected = brute_components(TEXTS, 4, 85, 100) | {None: None}
    assert all(r["component_id"] == expected[r["doc_id"]] for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 0
    assert ngram_join.jaccard_components(documents(spark).limit(0)).count() == 0


def test_a_repeated_id_keeps_the_links_of_each_text(spark):
    u, v, w = ([f"{x}{i}" for i in range(60)] for x in "uvw")
    near = lambda x: " ".join([*x[:-1], "end"])
    rows = [(1, " ".join(u)), (5, " ".join(u)), (5, " ".join(v)), (9, near(v)), (12, " ".join(w)), (13, " ".join(w)), (14, near(w))]
    got = ngram_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (5, 1), (5, 1), (9, 1), (12, 12), (13, 12), (14, 12)]


def test_each_linked_pair_shares_a_cell():
    """The pigeonhole bound, on random sets at the threshold: of a set with enough cells, or by the second deal."""
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        while True:
            c = np.unique(np.concatenate([b[1:], r.integers(0, 2**63, int(r.integers(0, 2))).astype(np.uint64)]))
            both = len(np.intersect1d(a, c))
            if not len(c) or 100 * both < 85 * (len(a) + len(c) - both):
                break
            b = c
        if np.array_equal(a, b):
            continue
        bands = ngram_join.Bands(85, 100)
        keys, sure = [], False
        for s in (a, b):
            own = {x: ngram_join._cells(s, np.zeros(len(s), np.int64), ngram_join._cell_number(bands.d[x]), x)[0] for x in bands.of(len(s)) if bands.d[x]}
            sure |= any(len(v) > bands.d[x] for x, v in own.items())
            keys.append(set(np.concatenate(list(own.values())).tolist()))
        both = np.intersect1d(a, b)
        assert (keys[0] & keys[1] or not sure) and len(both)
        # sketches of two lengths fold into one
        x, y = sorted((ngram_join.sketch(a).view(np.uint64), ngram_join.sketch(b).view(np.uint64)), key=len)
        far = sum(int(z).bit_count() for z in (x ^ (y if len(x) == len(y) else y[: len(x)] ^ y[len(x) :])).tolist())
        assert far <= len(a) + len(b) - 2 * len(both)


def shared_passages(seed, n=170):
    """Texts of one length made mostly of passages that many share, linked or not by what is left, and near copies of some."""
    r = random.Random(seed)
    passages = [[f"p{p}x{i}" for i in range(30)] for p in range(3)]
    out = []
    for i in range(n):
        own = [f"o{i}x{j}" for j in range(r.choice([1, 3, 6, 9, 14, 40]))]
        w = passages[i % 3] * 1 + (passages[(i + 1) % 3] if i % 2 else []) + own
        out.append(" ".join(w))
        if i % 4 == 0:
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("partners,told", [(16, 10**6), (1, 10**6), (0, 0)])
def test_passages_that_many_share(spark, monkeypatch, partners, told):
    """The same components whatever counts as hot, and by shuffles as by broadcasts."""
    if not told:
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rest, seen = ngram_join.Join.rest, []
    monkeypatch.setattr(ngram_join.Join, "rest", lambda self, rows: seen.append(rest(self, rows)))
    rows = shared_passages(partners) + [(10_000 + i, t) for i, t in near_copies(7, 5, 6)]
    expected = brute_components(rows, 4, 85, 100)
    got = ngram_join.jaccard_components(documents(spark, rows), k=4, num=85, den=100, partners=partners, told=told).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert len(set(expected.values())) < len(rows) - 20 and len(seen) == (partners < 2)


def test_texts_that_share_a_passage_do_not_become_pairs(spark, monkeypatch):
    """What a passage in common brings together, but sizes or folded sketches part, is never joined with its texts; near copies are."""
    verify, seen = ngram_join.Join.verify, []
    monkeypatch.setattr(ngram_join.Join, "verify", lambda self, pairs: (seen.append(pairs.count()), verify(self, pairs))[1])
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(passage + [f"o{i}x{j}" for j in range(30 + 10 * (i % 3))])) for i in range(90)]
    rows += [(100, rows[0][1] + " more")]
    got = ngram_join.jaccard_components(documents(spark, rows), k=4, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 100 for i, _ in rows}
    assert 0 < sum(seen) < len(rows)


def test_sets_that_share_many_hot_keys_become_one_pair(spark):
    """In the last join two sets meet at one key, or few, of the many that they share."""
    base = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join([*base[: 19 * i + 5], f"own{i}", *base[19 * i + 6 :]])) for i in range(8)]
    run = ngram_join.Join(documents(spark, rows).select("doc_id", "text"), 4, 85, 100, 0, 10**6)
    run.roots = spark.createDataFrame([], "node long, root long")
    hot = run.shared(run.every(run.sigs.selectExpr("doc_id", "explode(units.unit) AS unit")))
    dealt = run.shared(run.by_hot(hot))
    made = [(r["a"], r["b"]) for r in run.meeting(dealt).collect()]
    assert set(made) == {(a, b) for a in range(8) for b in range(a + 1, 8)} and len(made) <= 2 * 28
    at_each_key = dealt.groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert at_each_key > 5 * len(made)


def test_thresholds_too_low_are_refused(spark):
    with pytest.raises(ValueError, match="0.7"):
        ngram_join.jaccard_components(documents(spark), num=1, den=2)


def test_word_hashes_are_of_words():
    texts = ["The  THE\tthe", "", "é É", "x", "the"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, w = word_hashes(raw, at)
    assert w.tolist() == [0, 3, 3, 5, 6, 7]
    assert h[0] == h[1] == h[2] == h[6] and h[3] != h[4] and len({*h.tolist()}) == 4
    sh, s = shingle_hashes(h, w, 2)
    assert np.diff(s).tolist() == [2, 0, 1, 1, 1] and sh[0] == sh[1]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(7, 7)]
    got, other = ({x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), one_task=n).collect()} for n in (0, 10**6))
    assert got == other
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
    assert all(components(spark.createDataFrame([], "a long, b long"), one_task=n).count() == 0 for n in (-1, 10))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def brute_tile(a, b, least):
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return total
        total += n
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False


def test_tiles_are_greedy():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(3) for _ in range(r.randrange(40))] for _ in range(2))
        got = decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        assert sum(n for _, _, n in got) == brute_tile(a, b, 3)


def test_tiles_of_repeated_tokens(monkeypatch):
    """Whatever steps the search takes, and quickly."""
    import time

    r = random.Random(6)
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    for _ in range(60):
        a, b = ([r.randrange(2) for _ in range(r.randrange(60))] for _ in range(2))
        assert sum(n for _, _, n in decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 5)) == brute_tile(a, b, 5)
    monkeypatch.undo()
    began = time.perf_counter()
    assert sum(n for _, _, n in decontaminate.tile(np.ones(20_000, np.uint64), np.ones(200, np.uint64))) == 200
    assert time.perf_counter() - began < 5


def test_coverage_against_plain_tiling(spark):
    """All pairs that reach the coverage, of texts and items that share passages in any order."""
    r = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([4, 5, 9, 20, 41])))) for k in range(12)]
    rows = []
    for i in range(60):
        w = items[r.randrange(len(items))][1].split()
        cut = r.randrange(len(w) + 1)
        passages = [w[cut:], [r.choice(vocabulary) for _ in range(r.randrange(20))], w[: r.randrange(cut + 1)]]
        rows.append((i, " ".join(x for p in passages for x in p)))
    rows.append((100, " ".join(f"long{i % 5000}" for i in range(40_000)) + " " + items[3][1]))
    number = {}
    ids = lambda t: [number.setdefault(x, len(number)) for x in t.split()]
    expected = set()
    for i, t in rows[:-1]:
        for k, item in items:
            a, b = ids(t), ids(item)
            n = brute_tile(a, b, 5)
            if n and n >= 0.5 * len(b):
                expected.add((i, k, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["matched"]) for x in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert {x for x in got if x[0] != 100} == expected and len(expected) > 20
    assert (100, 3, len(items[3][1].split())) in got or len(items[3][1].split()) < 5


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_decontamination(spark, monkeypatch, seeds):
    if not seeds:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    w = ITEM.split()
    rows = [(1, f"Before it. {ITEM.upper()}, after."), (2, " ".join(w[8:] + ["and"] + w[:8])), (3, " ".join(w[:6]) + " and no more"), (4, "nothing of it"), (5, None), (1, f"Before it. {ITEM.upper()}, after."), (None, ITEM)]
    bench = spark.createDataFrame([(9, ITEM, "x"), (10, ITEM, "x"), (11, "", "x"), (12, None, "x"), (13, "too short", "x"), (None, ITEM, "x")], "item_id long, text string, digest string")
    docs = documents(spark, rows)
    got = decontaminate.contaminated(docs, bench, broadcast_seeds=seeds).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in got) == sorted((d, i) for d in (1, 1, 2, 0) for i in (9, 10, 0))
    assert {r["coverage"] for r in got} == {1.0} and {r["n_tiles"] for r in got if r["doc_id"] == 2} == {2}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, broadcast_seeds=seeds).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_licenses(spark):
    rows = [(1, "x\nLicensed under CC BY-NC 4.0.\ny"), (2, "this work was licensed under the GNU General Public License, version 3"), (3, "GNU General Public License, version 1, is an old license."), (4, None), (5, ""), (6, "Released under the MIT License.\nLicensed under CC BY 4.0."), (6, "Released under the MIT License."), (None, "Licensed under the Apache License, Version 2.0.")]
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["line"], r["license"], len(r["differences"])) for r in got) == [(0, 0, "Apache-2.0", 0), (1, 1, "CC-BY-NC-4.0", 0), (2, 0, "GPL-3.0", 1), (6, 0, "CC-BY-4.0", 0), (6, 0, "MIT", 0), (6, 0, "MIT", 0)]
    assert licenses.scan(documents(spark).limit(0)).count() == 0
    assert licenses.align(["a", "b", "c"], ["x", "a", "c", "y"]) == [("b", "")]


def test_license_notices_in_long_blocks(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))
    names = [name for name, _ in licenses.TEMPLATES]
    rows = [(100 * n + k, f"{prose(n)} {text} {prose(n // 2)}") for n in (8, 70, 3000) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(1, "Copyright 2001 by the holders of it.\n" * 8 + "Released under the MIT License."), (2, "\n".join(text for _, text in licenses.TEMPLATES))]
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(documents(spark, rows)).collect()}
    assert got == {(100 * n + k, name) for n in (8, 70, 3000) for k, name in enumerate(names)} | {(1, "MIT")} | {(2, name) for name in names}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright notice,"""
UNLICENSE = """This is free and unencumbered software released into the public
domain."""


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_license_notices(spark, sign):
    texts = {"MIT": MIT, "GPL-3.0-or-later": GPL, "BSD": BSD, "Unlicense": UNLICENSE}
    rows = [(k, "\n".join(["a first line", *(sign + x for x in text.split("\n"))])) for k, text in enumerate(texts.values())]
    rows += [(10 + k, text.replace("\n", f"\n{sign}") + "\n\n\n" + "plain words\n" * 9 + text) for k, text in enumerate(texts.values())]
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in licenses.scan(documents(spark, rows)).collect())
    again = [(10 + k, line, name) for k, (name, text) in enumerate(texts.items()) for line in (0, text.count("\n") + 12)]
    assert got == sorted([(k, 1, name) for k, name in enumerate(texts)] + again)
    assert licenses.scan(documents(spark, [(1, "free\nsoftware, licensed\nunder\nCC\nBY\n4.0.")])).select("line", "license").collect() == [(0, "CC-BY-4.0")]


def test_license_scan_against_plain_search(spark):
    """Each template hidden in prose is found, and prose alone never is."""
    r = random.Random(2)
    prose = [" ".join(r.choice("the of and river stone light under".split()) for _ in range(30)) for _ in range(len(licenses.TEMPLATES))]
    rows = [(k, f"{prose[k]}.\n{text}\n{prose[-k]}.") for k, (_, text) in enumerate(licenses.TEMPLATES)] + [(100 + k, p) for k, p in enumerate(prose)]
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(documents(spark, rows)).collect()}
    assert {(k, name) for k, (name, _) in enumerate(licenses.TEMPLATES)} <= got and not any(d >= 100 for d, _ in got)


def test_whole_wordings_have_no_differences(spark):
    got = licenses.scan(documents(spark, [(1, MIT), (2, BSD), (3, GPL)])).collect()
    assert sorted((r["doc_id"], r["license"], len(r["differences"])) for r in got) == [(1, "MIT", 0), (2, "BSD", 0), (3, "GPL-3.0-or-later", 0)]
    # wordings are compared, not what a sentence says of them
    assert [r["license"] for r in licenses.scan(documents(spark, [(1, "Not released under the MIT License.")])).collect()] == ["MIT"]


def brute_distance(template, block):
    """The fewest word edits between the template and any stretch of the block."""
    row = [0] * (len(block) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, b in enumerate(block, 1):
            new.append(min(row[j - 1] + (t != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_licenses_against_all_windows(spark):
    """Edited notices in prose: a licence is found where a template's distance from any window is small enough."""
    r = random.Random(12)
    prose = lambda n: [r.choice("stone river light under the of and by with copies software free".split()) for _ in range(n)]
    rows, expected = [], set()
    low = [(name, [w.lower() for w in licenses.words(text)]) for name, text in licenses.TEMPLATES]
    for i in range(60):
        name, text = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        own = licenses.words(text)
        plain = [k for k, w in enumerate(own) if not licenses._telling(w)]
        for k in r.sample(plain, min(len(plain), r.randrange(7))):
            own[k] = "changed"
        block = [*prose(r.randrange(90)), *own, *prose(r.randrange(90))]
        rows.append((i, " ".join(block)))
        near = {n: min(brute_distance(t, [w.lower() for w in licenses.words(rows[-1][1])]) - licenses.DIFFERENT * len(t) for m, t in low if m == n) for n in {name}}
        if near[name] <= 0:
            expected.add((i, name))
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(documents(spark, rows)).collect()}
    assert {x for x in got if x[1] == licenses.TEMPLATES[x[0] % len(licenses.TEMPLATES)][0]} == expected and 10 < len(expected) < 50


def toxic_corpus(n=900, seed=1):
    r = random.Random(seed)
    bad, parts = ["blargh", "snorfle", "grunkish"], "al be ga del ep ze the io ka lam mu nu xi om pi rho sig tau ver it see not".split()
    out = []
    for i in range(n):
        w = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 160))]
        y = int(i % 4 == 0)
        if y:
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "er"])
        out.append((i, " ".join(w), y))
    return out


def test_toxicity_learns_and_scores_held_out_rows(spark):
    rows = toxic_corpus()
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(10**6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns[-1] == "_score"
    got = {r["doc_id"]: r["_score"] for r in scored.collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and sum((got[i] >= 0.5) == y for i, y in held) >= 0.9 * len(held)
    edge = toxicity.score(documents(spark, extra=False), model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score(documents(spark).limit(0), model).count() == 0
    again = toxicity.Scorer(model)
    assert np.allclose(again.scores([t for _, t, _ in rows]), [got[i] for i, _, _ in rows])


def test_toxicity_scores_every_window(monkeypatch):
    """As the plain network on each window, whatever texts lie beside it."""
    monkeypatch.setattr(toxicity, "ROWS", 100)
    r, w = random.Random(5), toxicity.WINDOW
    texts = ["", None, " "] + [" ".join(r.choice(["al", "Be,", "gamma", "x", "(delta)", "é", "-", "epsilons"]) + r.choice(["", "s", str(r.randrange(40))]) for _ in range(n)) for n in (1, 2, w - 1, w, w + 1, 40, 333)]
    m = toxicity.fit(texts * 3, [k % 2 for k in range(3 * len(texts))])
    scorer = toxicity.Scorer(m)
    got = scorer.scores(texts)
    for t, score in zip(texts, got):
        words = toxicity.words_of(t)
        plain = m.logits(words)
        assert len(plain) == max(len(words) - w, 0) + 1 and np.allclose(scorer.logits(words), plain, atol=1e-3)
        assert abs(score - 1 / (1 + np.exp(-plain.max()))) < 1e-3


def test_toxicity_learns_word_and_character_rows():
    rows = toxic_corpus(200)
    before, after = toxicity.Model.fresh(), toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    for name in ("word", "char"):
        moved = (before.p[name][:, 1:] != after.p[name][:, 1:]).any(1).sum()
        assert moved > 200


def test_toxicity_inputs_are_of_words():
    """The n-grams of a word don't depend on the words beside it."""
    words = ["", "a", "idiot", "idiots", "éa"]
    b, grams, starts = toxicity.inputs(words)
    ends = [*starts[1:], len(grams)]
    for w, own, x, y in zip(words, b, starts, ends):
        alone = toxicity.inputs([w])
        assert alone[0][0] == own and alone[1].tolist() == grams[x:y].tolist() and y - x == sum(max(len(f"^{w or '$'}$".encode()) - n + 1, 0) for n in (3, 4, 5))


def test_toxicity_training_rows(spark):
    """Repeated rows count once, and at most the given number of each label is learnt from."""
    rows = toxic_corpus(60)
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows] * 2 + [(None, "x"), (61, None)]), spark.createDataFrame([(i, y) for i, _, y in rows] + [(61, 0), (61, 0)], "doc_id long, toxic int")
    learnt = [(i, t, y) for i, t, y in [*rows, (61, None, 0)] if zlib.crc32(str(i).encode()) % 5]
    learnt.sort(key=lambda x: zlib.crc32(str(x[0]).encode()))
    for n in (5, 100):
        own = [x for label in (0, 1) for x in [x for x in learnt if x[2] == label][:n]]
        own.sort(key=lambda x: zlib.crc32(str(x[0]).encode()))
        expected, got = toxicity.fit([t for _, t, _ in own], [y for _, _, y in own]), toxicity.train(docs, labels, sample=n)
        assert all(np.allclose(expected.p[k], got.p[k], atol=1e-5) for k in got.p)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(documents(spark), none)
    assert toxicity.score(documents(spark, extra=False), model).count() == len(TEXTS)


def test_toxicity_gradient():
    r = np.random.default_rng(0)
    m = toxicity.Model.fresh()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, live, y = r.normal(0, 1, (3, toxicity.WINDOW, 2 * toxicity.DIM)), np.ones((3, toxicity.WINDOW)), np.array([1.0, 0, 1])
    live[1, 20:] = 0
    g = m.gradient(x, live, y, np.ones(3))[1]
    for name in ("Wf", "Wb", "Uf", "Ub", "cf", "att", "out", "bias"):
        flat = m.p[name].reshape(-1)
        k, old = 0, float(flat[0])
        losses = []
        for step in (1e-3, -1e-3):
            flat[k] = old + step
            losses.append(m.gradient(x, live, y, np.ones(3))[0])
        flat[k] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - np.reshape(g[name], -1)[k]) < 1e-2 * abs(np.reshape(g[name], -1)[k]) + 1e-5  # states are of 32 bits
