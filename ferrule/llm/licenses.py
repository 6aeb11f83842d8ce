"""License scan by conditional compression.

Runs of lines that speak of licensing make blocks, and the words around each key word, as far as the longest template reaches, are searched for
notices, so that wrapping doesn't cut them. These words, in lower case, are cut into overlapping pieces of twice that length, so that their number
doesn't matter. Templates of which a piece lacks more words than may differ are left out, which loses none. A
piece is compressed alone and with each other template as a raw zstandard dictionary; the more a template shortens it, the likelier the piece
holds its words. Templates are ranked by that and aligned with the piece word by word: of those whose exact differences confirm them, the first has the
words. No least reduction is asked for, as an exact short notice can save nothing (zstandard stores less than 64 bytes of literals raw, so what a
match takes away can cost the rest its coding). Only wordings are compared: a notice within a sentence that denies it counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import map_arrow

#: Fixed wordings of public licence notices: identifier and text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Key words. Those of two words may be parted by a line's end and a comment's sign.
CANDIDATE = r"(?i)licen[cs]|copyright|redistribut|permission|public[^A-Za-z0-9]{1,12}domain|creative[^A-Za-z0-9]{1,12}commons|\bCC0?[\s-]|free[^A-Za-z0-9]{1,12}software"
#: Greatest part of a template's words that may differ.
DIFFERENT = 0.1
_KEY = re.compile(CANDIDATE)
_WORD = re.compile(r"[\w.+/:-]*\w")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def blocks(lines: list[int]) -> list[list[int]]:
    """First and last lines of runs of ascending line numbers; one line in between doesn't end a run."""
    out: list[list[int]] = []
    for k in lines:
        if out and k - out[-1][1] <= 2:
            out[-1][1] = k
        else:
            out.append([k, k])
    return out


def _costs(template: list[str], block: list[str]) -> np.ndarray:
    """For the first i words of the template and each place j of the block, the fewest differences of a stretch that ends there."""
    t, b = template, block
    cost = np.zeros((len(t) + 1, len(b) + 1), np.int32)
    cost[:, 0] = np.arange(len(t) + 1)
    for i, w in enumerate(t, 1):
        other = np.array([w != x for x in b], np.int32)
        step = np.minimum(cost[i - 1, :-1] + other, cost[i - 1, 1:] + 1)
        row, k = cost[i], np.arange(1, len(b) + 1)
        # insertions run from left to right: a prefix minimum of (value - place)
        row[1:] = np.minimum.accumulate(np.concatenate([[cost[i, 0]], step - k]))[1:] + k
    return cost


def _back(cost: np.ndarray, template: list[str], block: list[str], j: int) -> tuple[int, list[tuple[str, str]]]:
    """Where the stretch that ends at j begins, and its differences."""
    i, out = len(template), []
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (template[i - 1].lower() != block[j - 1].lower()):
            if template[i - 1].lower() != block[j - 1].lower():
                out.append((template[i - 1], block[j - 1]))
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            out.append((template[i - 1], ""))
            i -= 1
        else:
            out.append(("", block[j - 1]))
            j -= 1
    return j, out[::-1]


def align(template: list[str], block: list[str]) -> list[tuple[str, str]]:
    """The fewest differences (template's word, block's word; empty for none) between the template and any stretch of the block."""
    cost = _costs([w.lower() for w in template], [w.lower() for w in block])
    return _back(cost, template, block, int(cost[-1].argmin()))[1]


def stretches(template: list[str], block: list[str]) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """Stretches of the block (first word, word after the last, differences) that differ from the template in few words, none of them telling;
    of stretches that overlap the nearest."""
    cost = _costs([w.lower() for w in template], [w.lower() for w in block])
    ends, out = np.flatnonzero(cost[-1] <= DIFFERENT * len(template)), []
    for j in ends[np.argsort(cost[-1][ends], kind="stable")].tolist():
        if any(a < j <= b for a, b, _ in out):
            continue
        i, diff = _back(cost, template, block, j)
        if not any(_telling(x) for d in diff for x in d) and not any(i < b and a < j for a, b, _ in out):
            out.append((i, j, diff))
    return out


def _telling(word: str) -> bool:
    """Versions and abbreviations tell licences apart, so they may not differ."""
    return any(c.isdigit() for c in word) or (len(word) > 1 and word.isupper()) or word in ("Lesser", "Affero", "General", "Public")


def pieces(n: int, reach: int) -> list[tuple[int, int]]:
    """Pieces of 2 * reach of n words that overlap by half, so each stretch of up to `reach` words lies whole in one."""
    return [(a, min(a + 2 * reach, n)) for a in range(0, max(n - reach, 1), reach)]


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 9):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates = []
        for name, text in templates:
            raw = " ".join(words(text)).lower().encode()
            z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
            self.templates.append((name, words(text), Counter(w.lower() for w in words(text)), z))
        #: Words of the longest stretch that a template can be aligned with.
        self.reach = max(len(ws) + int(DIFFERENT * len(ws)) for _, ws, _, _ in self.templates)

    def scan(self, own: list[str]) -> list[tuple[str, float, list[tuple[str, str]], int, int]]:
        """Confirmed licences of words: name, reduction of its piece, differences, first word, word after the last. Templates are taken by what they
        save of their piece; the first whose wording is confirmed has the words, and others that overlap it don't count."""
        low, found = [w.lower() for w in own], []
        for a, b in pieces(len(own), self.reach):
            raw, have = " ".join(low[a:b]).encode(), Counter(low[a:b])
            # words that the piece lacks are differences, wherever it's aligned
            able = [t for t in self.templates if (t[2] - have).total() <= DIFFERENT * len(t[1])]
            alone = len(self.plain.compress(raw)) if able else 0
            for name, ws, _, z in able:
                reduction = 1 - len(z.compress(raw)) / alone
                found += [(name, reduction, diff, a + i, a + j) for i, j, diff in stretches(ws, own[a:b])]
        out, taken = [], set()
        for x in sorted(found, key=lambda x: (-x[1], len(x[2]), x[0], x[3])):
            here = range(x[3], x[4])
            if taken.isdisjoint(here):
                taken.update(here)
                out.append(x)
        return out


def notices(scanner: Scanner, text: str) -> list[tuple[int, str, float, list[tuple[str, str]]]]:
    """Confirmed licences of a text: first line of their block, name, reduction, differences; by block, nearest first, a licence once a block. A
    notice that reaches over several blocks belongs to the first."""
    hits = [m.start() for m in _KEY.finditer(text)]
    if not hits:
        return []
    spans, breaks = [m.span() for m in _WORD.finditer(text)], [m.start() for m in re.finditer("\n", text)]
    own, starts = [text[a:b] for a, b in spans], [a for a, _ in spans]
    runs = blocks([bisect_left(breaks, h) for h in hits])
    lasts, around = [b for _, b in runs], []
    for w in (bisect_right(starts, h) - 1 for h in hits):
        a, b = max(w - scanner.reach + 1, 0), min(w + scanner.reach, len(own))
        if around and a <= around[-1][1]:
            around[-1][1] = b
        else:
            around.append([a, b])
    found = []
    for a, b in around:
        for name, reduction, diff, i, _ in scanner.scan(own[a:b]):
            run = bisect_left(lasts, bisect_left(breaks, starts[a + i]))
            found.append((min(run, len(runs) - 1), len(diff), -reduction, name, diff))
    best = {}
    for run, _, red, name, diff in sorted(found, key=lambda x: x[:4]):
        best.setdefault((run, name), (runs[run][0], name, -red, diff))
    return list(best.values())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line, license, reduction, differences): a row for each confirmed licence of each block, line being the block's first with a key word (from 0),
    reduction the part of its piece's compressed size that the template saves (a short one may save none), and differences those of the nearest stretch.
    Null and empty texts have none; repeated rows have repeated results; null ids stay null. Of templates that save as much the nearest, then the first
    by name, comes first. A very long text is one row in one task, in pieces. Other columns don't matter, whatever their names; no rows give none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    scanner: list[Scanner] = []

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        own = scanner or scanner.append(Scanner()) or scanner
        at, line, name, red, diffs = [], [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            for first, found, reduction, diff in notices(own[0], t):
                at.append(i)
                line.append(first)
                name.append(found)
                red.append(reduction)
                diffs.append([{"template": x, "text": y} for x, y in diff])
        kind = pa.list_(pa.struct([("template", pa.string()), ("text", pa.string())]))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(name, pa.string()), pa.array(red, pa.float64()), pa.array(diffs, kind)], ["doc_id", "line", "license", "reduction", "differences"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, fn, f"doc_id {kind}, line long, license string, reduction double, differences array<struct<template: string, text: string>>")
