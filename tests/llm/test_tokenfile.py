import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import queries, tokenfile


@pytest.mark.parametrize(
    "ids",
    [
        [], [5], [1, 2], list(range(5000)), [7] * 20000, [3, 4, 9] * 3000, [2**28 + i * 977 % 5000 for i in range(9000)],
        np.random.default_rng(1).integers(0, 49408, 30000).tolist(), np.random.default_rng(2).zipf(1.3, 20000).clip(0, 60000).tolist(),
    ],
)
def test_round_trip(ids):
    a = np.array(ids, np.uint32)
    data = tokenfile.encode_segment([1, None], [len(ids), 0], a)
    keys, sizes, back = tokenfile.decode_segment(data)
    assert keys == [1, None] and sizes == [len(ids), 0] and np.array_equal(back, a)


def test_smaller_than_plain():
    a = (np.random.default_rng(3).zipf(1.4, 60000) % 40000).astype(np.uint32)
    assert len(tokenfile.encode_segment([1], [len(a)], a)) < 0.75 * 2 * len(a)
    b = np.tile(np.arange(200, dtype=np.uint32), 200)
    assert len(tokenfile.encode_segment([1], [len(b)], b)) < 0.2 * 2 * len(b)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_ids_of_texts_shrink_below_order_0_and_zstd(spark):
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in tokenfile.tokenize(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), end=1).collect()])
    bits = 8 * len(tokenfile.encode_segment([1], [len(ids)], ids)) / len(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    blocks = [ids[i : i + tokenfile.BLOCK_IDS].astype("<u2").tobytes() for i in range(0, len(ids), tokenfile.BLOCK_IDS)]
    assert bits < -(share * np.log2(share)).sum() < 8 * sum(len(zstandard.compress(b, 3)) for b in blocks) / len(ids)
    assert bits < 8


def test_damage_is_found_in_its_block():
    """The block named is the one that was hit, whichever it is; the last bytes of a block may decode all the same."""
    a = np.random.default_rng(4).zipf(1.2, 20000).clip(0, 45000).astype(np.uint32)
    data = tokenfile.encode_segment([1], [len(a)], a)
    lanes = -(-len(a) // tokenfile.BLOCK_IDS)
    at, parts = 5, []
    for _ in range(4):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    lengths = np.frombuffer(parts[3], "<u4").reshape(2, lanes)[0].tolist()
    assert at + sum(lengths) == len(data) and lanes == 5
    for i in range(lanes):
        for place in (0, 7, lengths[i] // 2):
            bad = bytearray(data)
            bad[at + sum(lengths[:i]) + place] ^= 255
            with pytest.raises(ValueError, match=f"block {i} is damaged"):
                tokenfile.decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        tokenfile.decode_segment(b"nothing of the kind")


def test_chunks_equal_the_library():
    with open(tokenfile.default_vocabulary(), encoding="utf-8") as f:
        chunks = tokenfile.Chunks(f.read())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "Hello, world!!  It's\n\nfine. 1234 x2", "É è ÀÉ ß ſ İ ǅ μ", "e\u0301 a\u0301b", "\x1c\x1d!\x1c!", "日本語 テスト", "don't 're 'S", "a\u00a0b\u2003c", "über straße. Ñandú; çà", "x." * 50, "...", "😀😀 ok", "tab\tand\rret\x85nel"]
    for _ in range(2):  # cold and warm
        for t, e in zip(texts, chunks.encode(texts)):
            assert np.frombuffer(e, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_strings_of_added_tokens():
    with open(tokenfile.default_vocabulary(), encoding="utf-8") as f:
        chunks = tokenfile.Chunks(f.read())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plain", "end <|endoftext|> start", "a<|startoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|> x", "< |endoftext|>", "\n<|startoftext|><|endoftext|> \n", "<|endof text|>", "plain too"]
    for _ in range(2):
        got = [np.frombuffer(e, "<u4").tolist() for e in chunks.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[1] == [806, 49407, 1572]


_CHUNKS: dict = {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n", "don't", "ÀÉ", "e\u0301", "...", "</w>", "x2", "Straße", "\u00a0"])), max_size=8).map("".join))
def test_any_text_equals_the_library(text):
    if not _CHUNKS:
        with open(tokenfile.default_vocabulary(), encoding="utf-8") as f:
            _CHUNKS["own"] = tokenfile.Chunks(f.read())
        _CHUNKS["library"] = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = _CHUNKS["library"].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_CHUNKS["own"].encode([text])[0], "<u4").tolist() == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    """The registered columns against the library, text by text."""
    sf = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.QUERIES["op6_token_ids"](spark, sf).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        x = got.pop(r.doc_id)
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_store(spark, docs, none, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = tokenfile.store(docs, str(tmp_path / "a"), end=1).collect()
    want = [(r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((repr(k), i) for k, i in want)
    rows = sorted(got, key=lambda r: r.start)
    keys = [r.doc_id for r in rows]
    assert keys == sorted((k for k in keys if k is not None)) + [None] * 2
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    assert tokenfile.store(none, str(tmp_path / "b"), end=1).count() == 0


def test_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RANGE_ROWS", 10)
    rows = [(i * 7919 % 1009, f"text number {i} " * (i % 5)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tokenfile.store(df, str(tmp_path / "a")).collect(), key=lambda r: r.doc_id)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r, (k, t) in zip(got, sorted(rows)):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert (r.doc_id, r.start, zlib.crc32(r.ids)) == (k, at, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(list((tmp_path / "a").glob("part-*"))) > 5


def test_prior_counts_every_pair():
    """A pair that stands seldom in a long segment, and only at odd places, is known to the prior."""
    import numpy as np

    from sluice.llm import tokenfile

    ids = np.tile(np.array([10, 11], np.int64), 600_000)
    ids[[100_001, 300_001, 500_001]] = 77
    ids[[100_002, 300_002, 500_002]] = 78
    prior = tokenfile.Prior.of(ids)
    assert dict(zip(prior.after.tolist(), prior.follower.tolist()))[77] == 78
