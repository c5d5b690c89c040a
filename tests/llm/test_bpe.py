import base64
import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import bpe, queries

NAMES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    with open(public_tokenizers.path(request.param), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.BytePairEncoder(bpe.read_ranks(data), public_tokenizers.PATTERN), theirs


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(pair, text):
    mine, theirs = pair
    ids = mine.encode(text)
    assert ids.tolist() == theirs.encode_ordinary(text)
    assert mine.decode(ids.tolist()) == text.encode()


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(["th", "er", " ", "in", "g", "é", "'s", "\n", "  ", "!!", "ing", "tion", "un", "日本", "1", "23", "\x1c", " ", "\xa0", "\t"]), max_size=60))
def test_merges(pair, parts):
    mine, theirs = pair
    assert mine.encode("".join(parts)).tolist() == theirs.encode_ordinary("".join(parts))


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, " " * 5000, "!" * 3000, "é" * 4000, "<|endoftext|>", "x" * 700 + "é日" * 500])
def test_long(pair, text):
    mine, theirs = pair
    assert mine.encode(text).tolist() == theirs.encode_ordinary(text)


def test_white_space_of_all_code_points(pair):
    mine, theirs = pair
    for c in [*range(0x3100), 0xFEFF, 0x1F600]:
        text = f"a {chr(c)}{chr(c)} 1{chr(c)}x"
        assert mine.encode(text).tolist() == theirs.encode_ordinary(text), hex(c)


def test_operators(spark, docs, none, pair):
    _, theirs = pair
    name = NAMES[0]
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((repr(r.doc_id), theirs.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    got = bpe.encode_and_decode(docs)
    assert sorted((repr(r.doc_id), list(r.ids), bytes(r.data)) for r in got.collect()) == want
    apart = bpe.decode(bpe.encode(docs).withColumnRenamed("ids", "tokens"), ids="tokens")
    assert sorted((repr(r.doc_id), bytes(r.data)) for r in apart.collect()) == sorted((k, d) for k, _, d in want)
    assert bpe.encode_and_decode(none).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_memory_starts_anew(monkeypatch, pair):
    mine, theirs = pair
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    rng = np.random.default_rng(1)
    for _ in range(50):
        text = " ".join("".join(rng.choice(list("abcdeth"), 8)) for _ in range(6))
        assert mine.encode(text).tolist() == theirs.encode_ordinary(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    """The registered columns against the library, text by text."""
    sf = "/root/testdata/sf0.001"
    with open(public_tokenizers.path(NAMES[0]), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.QUERIES["op10_byte_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, x = theirs.encode_ordinary(r.text or ""), got.pop(r.doc_id)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got
