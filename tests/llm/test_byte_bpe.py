"""Byte-level BPE against the tiktoken library, merging by hand and Python's decoder, with awkward rows."""

import hashlib
import random
import time

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from cloakwork.llm import byte_bpe, queries
from tests.conftest import SMALL

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
ALPHABETS = ["ab", "abcdefghijklmnopqrstuvwxyz", "éèüßaе漢字กข", "\U0001f600‍a é", " \n\ta1.", "0123456789", "()[]{};=_-#/*", " \n\t\x1c\x85　a'!\r", "'s 'll ab\n"]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("apart", [True, False])
def test_ids_equal_the_library(file, apart, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 500)
    monkeypatch.setattr(byte_bpe, "STATES", 300)
    monkeypatch.setattr(byte_bpe, "BLOCK", 1000)
    path, rng = P.path(file), random.Random(4)
    own, lib = byte_bpe.Encoder(byte_bpe.ranks_of(path), P.PATTERN, apart), library(path)
    texts = ["".join(rng.choice(rng_alphabet) for _ in range(rng.randrange(150))) for rng_alphabet in rng.choices(ALPHABETS, k=1500)]
    texts += pd.read_parquet(f"{SMALL}/documents.parquet").text.tolist()[:150] + ["", "a" * 20_000, " " * 3000 + "x", "abc\n \n b " * 500]
    assert [list(x) for x in own.encode([*texts, None])] == [lib.encode_ordinary(t) for t in texts] + [[]]
    assert own.ranks.longest_wait < 32


def test_pieces_are_read_abreast(monkeypatch):
    """Distinct words, which no memory of words helps with, cost a step for each place in the words and not one for each byte."""
    rng, lib = random.Random(9), library(P.path(FILES[0]))
    own = byte_bpe.Encoder(byte_bpe.ranks_of(P.path(FILES[0])), P.PATTERN, True)
    words = sorted({"".join(rng.choices(["in", "er", "the", "ä", "ouß", "漢", "q"], k=rng.randrange(2, 9))) for _ in range(20_000)})
    alone, compiled = [], []
    read_on, move = byte_bpe.Ranks.read_on, byte_bpe.Ranks.move
    monkeypatch.setattr(byte_bpe.Ranks, "read_on", lambda self, state, data: alone.append(len(data)) or read_on(self, state, data))
    monkeypatch.setattr(byte_bpe.Ranks, "move", lambda self, state, byte: compiled.append(byte) or move(self, state, byte))
    text = " ".join(words)
    assert [list(x) for x in own.encode([text])] == [lib.encode_ordinary(text)]
    assert sum(alone) < 500 and len(compiled) < len(text.encode()) / 2
    # states that are dropped while pieces are read, down to one piece at a time; and pieces of which few or none are read abreast
    for states, few in ((300, 1), (40, 1), (8, 2), (300, 16), (byte_bpe.STATES, 1 << 20)):
        monkeypatch.setattr(byte_bpe, "STATES", states)
        monkeypatch.setattr(byte_bpe, "FEW", few)
        own = byte_bpe.Encoder(byte_bpe.ranks_of(P.path(FILES[0])), P.PATTERN, True)
        some = [" ".join(words[k::40]) for k in range(3)]
        assert [list(x) for x in own.encode(some)] == [lib.encode_ordinary(t) for t in some]


def test_parts_of_all_kinds_are_split_as_one_text():
    own, rng = byte_bpe.Encoder(byte_bpe.ranks_of(P.path(FILES[0])), P.PATTERN, True), random.Random(10)
    lib = library(P.path(FILES[0]))
    texts = ["".join(rng.choices([" ", "\n", "\t", "\x1c", "\u3000", "a", "it's", "1", "é", "漢", "."], k=rng.randrange(12))) for _ in range(4000)]
    assert [list(x) for x in own.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_texts_decoded_together_equal_pythons_decoder():
    rank = byte_bpe.ranks_of(P.path(FILES[0]))
    own, rng = byte_bpe.Decoder({r: t for t, r in rank.items()}), random.Random(11)
    for _ in range(60):
        raw = [bytes(rng.choices([0x61, 0x80, 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xEF, 0xBF, 0xBD], k=rng.randrange(6))) for _ in range(rng.randrange(30))]
        raw += rng.choices(["é漢\ufffd".encode(), b"", "a漢".encode(), "漢".encode()[:2], "漢".encode()[2:]], k=8)
        starts = np.cumsum([0, *map(len, raw)])
        data, text = own.columns(np.array([rank[bytes([b])] for b in b"".join(raw)], np.int32), starts)
        assert data.to_pylist() == raw and text.to_pylist() == [r.decode("utf-8", "replace") for r in raw]
    assert [c.to_pylist() for c in own.columns(np.zeros(0, np.int32), np.zeros(3, np.int64))] == [[b"", b""], ["", ""]]


def test_neighbours_equal_merging_by_hand():
    own, rng = byte_bpe.Ranks(byte_bpe.ranks_of(P.path(FILES[0]))), random.Random(5)
    tokens = [t for t in own.ends if t != byte_bpe.NONE]
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5 and len(both := own.merged(own.token[a] + own.token[b])) > 1:
            a, b = both[-2:]
        assert own.may_follow(a, b) == (own.merged(own.token[a] + own.token[b]) == [a, b])


def test_tokens_are_given_out_while_a_piece_is_read():
    own = byte_bpe.Ranks(byte_bpe.ranks_of(P.path(FILES[0])))
    rng, state, given = random.Random(6), own.start, 0
    piece = bytes(rng.choice(b"etaoinshrdlu") for _ in range(3000))
    for i, b in enumerate(piece):
        state, sure = own.move(state, b)
        given += len(sure)
        assert sum(len(g) for _, g in state.paths) < 200
    assert given > len(own.encode_piece(piece)) - 40


def test_the_utf8_machine_equals_pythons_decoder():
    rank = byte_bpe.ranks_of(P.path(FILES[0]))
    own, rng = byte_bpe.Decoder({r: t for t, r in rank.items()}), random.Random(7)
    odd = [0x61, 0x80, 0xBF, 0xC2, 0xC0, 0xE0, 0xA0, 0x9F, 0xED, 0xEF, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF]
    for _ in range(3000):
        raw = bytes(rng.choice(odd) for _ in range(10))
        for ids in ([rank[bytes([b])] for b in raw], [rng.randrange(len(rank)) for _ in range(12)]):
            data = own.data(np.array(ids, np.int32))
            assert own.text(np.array(ids, np.int32)) == "".join(own.stream(ids)) == data.decode("utf-8", "replace")
    # characters come as soon as they are whole
    stream = own.stream(iter([rank[bytes([b])] for b in "é!".encode()]))
    assert next(stream) == "é" and next(stream) == "!"


def test_long_pieces_take_linear_time():
    own, rng = byte_bpe.encoder(P.path(FILES[0]), P.PATTERN, True), random.Random(8)
    for text in ("a" * 1_000_000, "".join(rng.choice("abcdefghij") for _ in range(200_000)), " " * 500_000 + "x", "ab " * 200_000):
        start = time.time()
        (ids,) = own.encode([text])
        assert time.time() - start < 10
        assert byte_bpe.decoder(P.path(FILES[0])).text(np.array(ids)) == text


def test_tables(spark):
    rows = [(1, "Hello  world\n\nit's 12 é漢\U0001f600", "x"), (1, "Hello", "x"), (2, "", "y"), (None, None, "z"), (3, "x" * 100_000, "n"), (4, "<|endoftext|>", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path, lib = P.path(FILES[0]), library(P.path(FILES[0]))
    encoded = byte_bpe.encode(docs, path, P.PATTERN)
    got = sorted(((r.doc_id or 0, list(r.ids), r.n_tokens) for r in encoded.collect()))
    assert got == sorted((i or 0, lib.encode_ordinary(t or ""), len(lib.encode_ordinary(t or ""))) for i, t, _ in rows)
    back = sorted((r.doc_id or 0, r.text, bytes(r.decoded)) for r in byte_bpe.decode(encoded, path).collect())
    assert back == sorted((i or 0, t or "", (t or "").encode()) for i, t, _ in rows)
    both = sorted((r.doc_id or 0, list(r.ids), r.n_tokens, r.text) for r in byte_bpe.round_trip(docs, path, P.PATTERN, True).collect())
    assert both == sorted((*g, t or "") for g, (_, t, _) in zip(sorted(got), sorted(rows, key=lambda r: (r[0] or 0, lib.encode_ordinary(r[1] or "")))))
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), path, P.PATTERN), path).count() == 0
    cut = spark.createDataFrame([(1, [lib.encode_single_token(b"\xc3")]), (2, None)], "doc_id long, ids array<long>")
    assert sorted((r.doc_id, r.text, bytes(r.decoded)) for r in byte_bpe.decode(cut, path).collect()) == [(1, "�", b"\xc3"), (2, "", b"")]


def test_query(spark):
    lib = library(P.path(FILES[0]))
    want = {}
    for i, t in pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "text"]].itertuples(index=False):
        ids = lib.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_byte_bpe"](spark, SMALL).collect()} == want
