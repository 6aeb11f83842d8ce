"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is the encoding of the pair's own bytes.
That makes encoding a finite-state matter: the nondeterministic transducer has a state for (last token, place in the vocabulary
trie), and may end a token wherever the next one may stand beside the last. The transducer is determinised as it is used: a state is
the set of live configurations with the tokens that each has not yet put out. Tokens that all configurations agree on go out
at once, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import gc
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ferrule.llm.common import free_name, held, list_array, map_arrow, tokenizer_path
from ferrule.llm.pieces import PartMemo, part_memo

RANKS = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    out = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                out[base64.b64decode(token)] = int(rank)
    return out


class Transducer:
    """encode(piece): the token ids of one pre-token. States are made when first reached; beyond max_states all are forgotten."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: b for b, r in ranks.items()}
        # the trie: children by node * 256 + byte, and the token that ends at each node
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[int, list[tuple[bytes, float]]] = {}
        self.pairs: dict[int, bool] = {}
        # tokens that merges never make can only be whole pre-tokens
        self.token_at = [t if t < 0 or len(self.bytes_of[t]) == 1 or self._split(t) else -1 for t in self.token_at]
        self.reset()

    def reset(self) -> None:
        # a configuration set is a flat tuple: for each configuration its waiting tokens, its last token and its trie node. A state is a
        # dict: its configurations at -1, and by byte the state that it goes to, with the tokens that go out on the way in front, if any do
        for state in getattr(self, "configs", {}).values():
            state.clear()  # states lead to each other in circles
        self.configs: dict[tuple, dict] = {}
        self.start = self._state(((), -1, 0))

    def _state(self, flat: tuple) -> dict:
        state = self.configs.get(flat)
        if state is None:
            state = self.configs[flat] = {-1: flat}
        return state

    # which tokens may stand beside each other

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token, found by merging its bytes; None for a byte or a token that merges never reach."""
        if token not in self.halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            half = None
            while len(parts) > 1:
                best = None
                for i in range(len(parts) - 1):
                    r = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]])
                    if r is not None and (best is None or r < best[0]):
                        best = (r, i)
                if best is None:
                    break
                if len(parts) == 2:
                    half = (parts[0], parts[1])
                parts[best[1] : best[1] + 2] = [best[0]]
            self.halves[token] = half if parts == [token] else None
        return self.halves[token]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The bytes of the tokens that stand at one edge of the token while it is built, each with the rank of the merge that ends it."""
        key = token << 1 | side
        if key not in self.spines:
            out, end = [], float("inf")
            while True:
                out.append((self.bytes_of[token], end))
                half = self._split(token)
                if half is None:
                    break
                end, token = token, half[side]
            self.spines[key] = out
        return self.spines[key]

    def fits(self, a: int, b: int) -> bool:
        """If a then b is the encoding of their joined bytes: no merge across the border comes before those on either side."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            get = self.ranks.get
            known, right = True, self._spine(b, 0)
            for left, x_end in self._spine(a, 1):
                for y, y_end in right:
                    r = get(left + y)
                    if r is not None and r < x_end and r <= y_end:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    # the determinised machine

    def _move(self, state: dict, byte: int) -> dict | tuple[tuple[int, ...], dict]:
        """The state that a state goes to on a byte, after the tokens that go out on the way, if any do."""
        child, token_at, pairs, ended = self.child.get, self.token_at, self.pairs.get, False
        flat, each = [], iter(state[-1])
        for out, last, node in zip(each, each, each):
            nxt = child(node << 8 | byte)
            if nxt is not None:
                flat += (out, last, nxt)
                if not ended:  # what has been read has one encoding, so one configuration at most ends a token here
                    token = token_at[nxt]
                    if token >= 0:
                        known = True if last < 0 else pairs(last << 32 | token)
                        if known or known is None and self.fits(last, token):
                            flat += ((*out, token), token, 0)
                            ended = True
        first = flat[0]
        if first:  # else one configuration waits for nothing, so none can go out
            outs, k = flat[3::3], 0
            while k < len(first) and all([len(x) > k and x[k] == first[k] for x in outs]):
                k += 1
            if k:
                flat[::3] = [x[k:] for x in flat[::3]]
                to = state[byte] = (first[:k], self._state(tuple(flat)))
                return to
        to = state[byte] = self._state(tuple(flat))
        return to

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        if len(self.configs) > self.max_states:
            self.reset()
        state, out = self.start, []
        for b in piece:
            try:
                to = state[b]
            except KeyError:
                if len(self.configs) > self.max_states:  # within a long piece all are forgotten but the one it is in
                    flat = state[-1]
                    self.reset()
                    state = self._state(flat)
                to = self._move(state, b)
            if to.__class__ is tuple:
                put, state = to
                out += put
            else:
                state = to
        # the waiting tokens of the configuration that has just ended a token
        each = iter(state[-1])
        for waiting, _, node in zip(each, each, each):
            if not node:
                out += waiting
                break
        return out


class Utf8Machine:
    """Incremental UTF-8: feed() takes bytes in any cuts and gives the text that is complete; flush() ends it. Each maximal ill-formed
    part becomes U+FFFD, as in Python's errors="replace"."""

    #: (least lead byte, greatest, least second byte, greatest, length); fixed values of the UTF-8 definition.
    FORMS = ((0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3), (0xED, 0xED, 0x80, 0x9F, 3), (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4), (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4))

    def __init__(self):
        self.low, self.high, self.need, self.code = 0x80, 0xBF, 0, 0

    def feed(self, data: bytes) -> str:
        """Bytes within whole characters are decoded at once; the machine walks over what a cut has split, and over ill-formed parts."""
        head = 0
        if self.need:
            head = 1
            while head < len(data) and head < 4 and 0x80 <= data[head] <= 0xBF:
                head += 1
        tail = len(data)
        while tail > head and len(data) - tail < 3 and 0x80 <= data[tail - 1] <= 0xBF:
            tail -= 1
        if tail > head and data[tail - 1] >= 0xC0:
            tail -= 1
        else:
            tail = len(data)
        try:
            middle = data[head:tail].decode()
        except UnicodeDecodeError:
            return self._walk(data)
        return self._walk(data[:head]) + self._join(middle) + self._walk(data[tail:])

    def _join(self, middle: str) -> str:
        """A character that is still open before the middle is ill-formed."""
        if self.need and middle:
            self.low, self.high, self.need = 0x80, 0xBF, 0
            return "\ufffd" + middle
        return middle

    def _walk(self, data: bytes) -> str:
        out, i, n = [], 0, len(data)
        while i < n:
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    i += 1
                else:  # the byte is looked at again, as a first one
                    out.append("\ufffd")
                    self.need, self.low, self.high = 0, 0x80, 0xBF
                continue
            i += 1
            if b < 0x80:
                out.append(chr(b))
                continue
            form = next((f for f in self.FORMS if f[0] <= b <= f[1]), None)
            if form is None:
                out.append("\ufffd")
            else:
                self.low, self.high, self.need = form[2], form[3], form[4] - 1
                self.code = b & (0x7F >> form[4])
        return "".join(out)

    def flush(self) -> str:
        out = "\ufffd" if self.need else ""
        self.__init__()
        return out


class Decoder:
    """Ids to bytes and to text. Tokens of ASCII only leave the machine in its first state and are joined without it."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.table = [b""] * size
        for token, rank in ranks.items():
            self.table[rank] = token

    def raw(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def text(self, ids, cut: int = 4096) -> str:
        """Streaming: the machine sees the bytes of a few tokens at a time, whose cuts may fall within characters."""
        machine = Utf8Machine()
        parts = [machine.feed(self.raw(ids[k : k + cut])) for k in range(0, len(ids), cut)]
        return "".join(parts) + machine.flush()


def text_encoder(ranks: dict[bytes, int], pattern: str) -> PartMemo:
    """It gives ids as native 32-bit integers. The garbage collector rests while it is held: its tables are freed without it, and walking them is costly."""
    gc.disable()
    machine = Transducer(ranks)
    return part_memo(pattern, lambda piece: array("i", machine.encode(piece.encode())).tobytes(), 150_000)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """docs (without the text, if keep_text is false) with a column of token ids (array<int>) in place of a column of that name. Null and empty texts give no ids; other columns, null
    or not, and repeated rows stay as they are. If docs has a column whose name differs only in case, ids gets a name of its own
    by underscores in front (see common.free_name). If decoded is a name, that column has the text that the ids decode to, in the same
    pass over the texts. A very long text is one row in one task, whose machine forgets states beyond its bound; equal texts have equal ids; an empty
    table gives no rows."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(RANKS), pattern or public_tokenizers.PATTERN
    docs = docs.drop(ids) if ids in docs.columns else docs
    ids = free_name(docs, ids)
    at = docs.columns.index(text)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, dec = held(("bpe", path, pattern), lambda: [(text_encoder(ranks, pattern), Decoder(ranks)) for ranks in [load_ranks(path)]][0])
        parts = [b"".join(enc.values(t or "")) for t in b.column(at).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]) if parts else np.zeros(1, np.int64)
        col = list_array(np.frombuffer(b"".join(parts), "<i4"), offsets, pa.int32())
        cols, names = [*b.columns], [*b.schema.names]
        if not keep_text:
            del cols[at], names[at]
        if decoded:
            return pa.RecordBatch.from_arrays([*cols, col, pa.array([dec.text(array("i", p)) for p in parts], pa.string())], [*names, ids, decoded])
        return pa.RecordBatch.from_arrays([*cols, col], [*names, ids])

    return map_arrow(docs, fn, T.StructType([*(f for f in docs.schema.fields if keep_text or f.name != text), T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])]), holds=True)


def decode(df: DataFrame, ids: str = "ids", raw: str = "decoded", text: str | None = None, path: str | None = None) -> DataFrame:
    """df with the decoded bytes and, if text is a name, the decoded text (ill-formed parts as U+FFFD). Null ids give empty ones."""
    path = path or tokenizer_path(RANKS)
    at = df.columns.index(ids)
    raw = free_name(df, raw)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        dec = held(("bpe decoder", path), lambda: Decoder(load_ranks(path)))
        lists = b.column(at)
        values, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        null = lists.is_null().to_numpy(zero_copy_only=False)
        each = lambda i: values[off[i] : off[i + 1]].tolist() if not null[i] else []  # noqa: E731  one document's ids at a time
        cols, names = [*b.columns, pa.array([dec.raw(each(i)) for i in range(len(lists))], pa.binary())], [*b.schema.names, raw]
        if text:
            cols, names = [*cols, pa.array([dec.text(each(i)) for i in range(len(lists))], pa.string())], [*names, text]
        return pa.RecordBatch.from_arrays(cols, names)

    fields = [*df.schema.fields, T.StructField(raw, T.BinaryType()), *([T.StructField(text, T.StringType())] if text else [])]
    return map_arrow(df, fn, T.StructType(fields), holds=True)
