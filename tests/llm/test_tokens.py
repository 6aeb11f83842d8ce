import gc
import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrule.llm import bpe, common, token_files, wordpiece
from ferrule.llm.pieces import LETTERS_FIRST, Memo, part_memo

from .common import TEXTS, documents, texts_by_row

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.text_encoder(RANKS, public_tokenizers.PATTERN)
MACHINE = bpe.Transducer(RANKS, max_states=2000)


def ids_of(text):
    enc = ENCODER
    return np.frombuffer(b"".join(enc.values(text)), "<i4").tolist()


def test_pattern_is_the_public_one():
    assert LETTERS_FIRST == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehnorst .,'\n\t 1é世😀\u00a0\x1c", max_size=60))
def test_encoding_is_the_librarys(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_random_bytes_as_one_piece():
    r = random.Random(5)
    for _ in range(2000):
        piece = bytes(r.choice(b"aabcdetionhs \xc3\xa9\x00z!1") for _ in range(r.randint(1, 25)))
        assert MACHINE.encode(piece) == LIBRARY._encode_single_piece(piece)


def test_states_are_bounded_within_a_piece():
    small, r = bpe.Transducer(RANKS, max_states=50), random.Random(3)
    piece = bytes(r.choice(b"abcdefgh") for _ in range(3000))
    assert small.encode(piece) == LIBRARY._encode_single_piece(piece) and len(small.configs) <= 52


def test_forgotten_states_need_no_garbage_collector():
    machine = bpe.Transducer(RANKS)
    machine.encode(b" abcabcxyzzyabc")
    gc.collect()
    assert len(machine.configs) > 10
    machine.reset()
    assert gc.collect() == 0


def test_what_is_held_is_not_walked_after_each_task():
    frame = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda key: "1")), mapInArrow=lambda run, schema: run)
    run = common.map_arrow(frame, lambda b: b, "", holds=True)
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    try:
        gc.unfreeze()
        assert [b.num_rows for b in run([rows])] == [2] and gc.get_freeze_count() > 0
    finally:
        gc.unfreeze()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(data, step):
    m = bpe.Utf8Machine()
    got = "".join(m.feed(data[k : k + step]) for k in range(0, len(data), step)) + m.flush()
    assert got == data.decode("utf-8", "replace")


def test_memo_is_bounded():
    m = Memo(lambda k: k + 1, 10)
    assert [m[k] for k in range(100)] == list(range(1, 101)) and len(m) + len(m.old) <= 20


def test_usual_parts_need_no_pattern(monkeypatch):
    text = "Aa the$$$ x.\nAnd on,*** (b).\nÉa è:\nso end"
    want = ENCODER.values(text)
    memo = part_memo(LETTERS_FIRST, ENCODER.letters, 1000)
    seen = []
    monkeypatch.setattr(memo.make, "find", lambda part: (seen.append(part), regex.findall(LETTERS_FIRST, part))[1])
    assert b"".join(memo.values(text)) == b"".join(want) and np.frombuffer(b"".join(want), "<i4").tolist() == LIBRARY.encode_ordinary(text)
    assert seen == [" (b)."]


MEMO = token_files._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehst  ..,'$*_-\n\n\t1é世😀\u00a0\x1c\u0345²", max_size=60))
def test_file_ids_are_the_librarys(text):
    assert np.frombuffer(token_files.text_ids(MEMO, text), MEMO.kind).tolist() == MEMO.keep.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_encode_decode(spark):
    docs = documents(spark)
    got = bpe.encode(docs.drop("ids")).collect()
    assert [list(r["ids"]) for r in got] == [LIBRARY.encode_ordinary(t or "") for _, t in TEXTS]
    back = bpe.decode(bpe.encode(docs.drop("ids")), text="again").collect()
    assert [(bytes(r["decoded"]).decode(), r["again"]) for r in back] == [(t or "", t or "") for _, t in TEXTS]
    kept = bpe.encode(docs, keep_text=False, decoded="back")
    assert "text" not in kept.columns and [r["back"] for r in kept.collect()] == [t or "" for _, t in TEXTS]
    assert bpe.encode(docs.limit(0)).count() == 0
    clash = bpe.encode(docs.drop("ids").withColumnRenamed("source", "IDS"))
    assert clash.columns[-1] == "_ids" and clash.count() == len(TEXTS)


def test_pack_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 2**32, n) >> r.choice([0, 8, 16, 24], n)).astype(np.uint32)
        control, data = token_files.pack(x)
        assert (token_files.unpack(control, data, n) == x).all() and len(control) == (n + 3) // 4
    block = token_files.block_bytes([5, None], np.array([1, 2]), np.array([7, 300, 70000], np.uint32)) + token_files.END
    assert [(d, c.tolist(), x.tolist()) for d, c, x in token_files.read_blocks(block)] == [([5, None], [1, 2], [7, 300, 70000])]
    with pytest.raises(ValueError):
        list(token_files.read_blocks(b"XXXX" + block[4:]))
    with pytest.raises(ValueError):
        list(token_files.read_blocks(block[:-1] + b"?"))


def test_token_files(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write(documents(spark), f"file://{tmp_path}/o")
    got = sorted(token_files.read(spark, f"file://{tmp_path}/o").collect(), key=lambda r: r["start"])
    expected = [(i, t.encode(x, add_special_tokens=False).ids + [2]) for i, x in texts_by_row()]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got if r["doc_id"] != 2] == [e for e in expected if e[0] != 2]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    token_files.write(documents(spark).limit(0), f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def test_added_tokens_are_the_librarys(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> \n<|endoftext|><|endoftext|>  é", "<|endoftext |>", "plain text"]
    token_files.write(documents(spark, list(enumerate(texts))), f"file://{tmp_path}/o")
    got = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read(spark, f"file://{tmp_path}/o").collect()}
    want = [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert got == {k: (sum(map(len, want[:k])), x) for k, x in enumerate(want)} and 50256 in got[0][1] and 50256 not in got[3][1]


def greedy(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return None
        word, n = word[k:], n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=15), st.lists(st.integers(97, 99), max_size=12).map(bytes))
def test_longest_match(vocabulary, word):
    expected = greedy(word, vocabulary)
    assert wordpiece.LongestMatch(vocabulary).count(word) == (1 if expected is None else expected)


def test_longest_match_with_inner_pieces():
    m = wordpiece.LongestMatch([b"un", b"unaff", b"##aff", b"##able", b"a", b"##a", b"##b", b"##le"], inner=b"##")
    assert [m.count(w) for w in (b"unaffable", b"una", b"able", b"x", b"", b"aa")] == [2, 2, 3, 1, 0, 2]


def test_token_counts(spark):
    find = regex.compile(public_tokenizers.PATTERN).findall
    got = wordpiece.token_counts(documents(spark, extra=False)).collect()
    assert [(r["n_words"], r["n_tokens"]) for r in got] == [(len(find(t or "")), sum(greedy(w.encode(), RANKS) for w in find(t or ""))) for _, t in TEXTS]
    assert wordpiece.token_counts(documents(spark)).columns[-1] == "_n_tokens"
    assert wordpiece.token_counts(documents(spark).limit(0)).count() == 0


def test_digests_are_those_of_the_contract(spark, tmp_path):
    from ferrule.llm.queries import QUERIES

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op5_bpe_transducer"](spark, str(tmp_path)).collect():
        text = next((t or "" for i, t in TEXTS if i == r["doc_id"]))
        ids = LIBRARY.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    crcs = {zlib.crc32(np.array(LIBRARY.encode_ordinary(t or "") + [2], "<u4").tobytes()) for _, t in TEXTS}
    assert {r["ids_crc32"] for r in QUERIES["op6_token_files"](spark, str(tmp_path)).collect()} == crcs
