"""Token counts by greedy longest match in time linear in the text.

A trie of the vocabulary has, at each node, a failure link and the number of pieces that following it pops: when the match can't go
on at a node, that many pieces are complete, and matching goes on from the link's node. No piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ferrule.llm.bpe import RANKS, load_ranks
from ferrule.llm.common import free_name, held, map_arrow, tokenizer_path
from ferrule.llm.pieces import Memo, PartMemo


class LongestMatch:
    """count(word): the pieces of a word by greedy longest match from the left; 1 (one unknown piece) if it can't be covered.

    Where `inner` is given, pieces other than a word's first are those that begin with it ("##" in some vocabularies)."""

    def __init__(self, vocabulary: Iterable[bytes], inner: bytes = b""):
        self.child: dict[int, int] = {}
        ends = [False]
        self.root = 0

        def node_of(token: bytes, node: int) -> int:
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(ends)
                    ends.append(False)
                node = nxt
            return node

        self.again = node_of(inner, 0) if inner else 0
        for token in vocabulary:
            if token and token != inner:
                ends[node_of(token, 0)] = True
        n = len(ends)
        self.link, self.pops = [-1] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, nxt in self.child.items():
            below[key >> 8].append((key & 255, nxt))
        # by depth; the root of inner pieces is a start of its own
        level = [0]
        while level:
            deeper = []
            for u in level:
                for b, v in below[u]:
                    deeper.append(v)
                    if v == self.again:
                        continue
                    if ends[v]:
                        self.link[v], self.pops[v] = self.again, 1
                        continue
                    z, popped = self.link[u], self.pops[u]
                    while z >= 0 and (z << 8 | b) not in self.child:
                        popped, z = popped + self.pops[z], self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.child[z << 8 | b], popped
            level = deeper

    def count(self, word: bytes) -> int:
        child, u, n = self.child, self.root, 0
        for b in word:
            while (v := child.get(u << 8 | b)) is None:
                if self.link[u] < 0:
                    return 1
                n, u = n + self.pops[u], self.link[u]
            u = v
        while u != self.again:
            if self.link[u] < 0:
                return 1 if u != self.root else n
            n, u = n + self.pops[u], self.link[u]
        return n


def _counter(path: str, pattern: str) -> PartMemo:
    count, find = LongestMatch(load_ranks(path)).count, regex.compile(pattern).findall
    word = Memo(lambda w: count(w.encode()))

    def part(text: str) -> tuple[int, int]:
        words = find(text)
        return len(words), sum([word[w] for w in words])

    return PartMemo(part)


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with n_words (matches of the pattern) and n_tokens (their pieces by greedy longest match over the rank file's tokens; each byte is a
    token, so every word is covered). Null and empty texts have 0 and 0; repeated rows and other columns stay; if a name is taken, the
    new column gets underscores in front. Of pieces that begin at one place the longest counts, so there are no ties. A very long text is one row in
    one task; an empty table gives no rows."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(RANKS), pattern or public_tokenizers.PATTERN
    at = docs.columns.index(text)
    words, tokens = free_name(docs, "n_words"), free_name(docs, "n_tokens")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = held(("longest match", path, pattern), lambda: _counter(path, pattern))
        sums = []
        for t in b.column(at).to_pylist():
            got = c.values(t or "")
            sums.append((sum([x[0] for x in got]), sum([x[1] for x in got])))
        both = np.array(sums, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], [*b.schema.names, words, tokens])

    return map_arrow(docs, fn, T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(tokens, T.LongType())]), holds=True)
