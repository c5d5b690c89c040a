"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The vocabulary's byte strings are read as Latin-1 so that pyahocorasick finds, in one
scan, the longest token that starts at each byte. The encoder walks left to right with
those longest matches. Two adjacent tokens can stand side by side in a merge result only
if no merge across their border would have come first; that test is a walk down the two
tokens' merge trees and is memoised for each pair. Where a token doesn't fit its left
neighbour the next shorter token that is its prefix is tried, and where none fits the
left neighbour is taken back and its end marked as a dead end, so that each end of a
token is given up once at most: the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sluice.llm.common import bounded_batches, held, strings, tidy

#: Rust's \s, which Python's differs from in U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Pieces whose ids a worker remembers at most; beyond it the memory starts anew.
MEMO_PIECES = 350_000

#: Two white-space characters in a row.
RUN = re.compile(r"\s\s")

#: Pairs of adjacent tokens whose verdict a worker remembers at most.
MEMO_PAIRS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Pieces(dict):
    """Piece of text -> its ids as bytes of 32-bit integers, filled on demand."""

    def __init__(self, encoder: "BytePairEncoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str):
        ids = array("i", self.encoder.encode_piece(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:  # long pieces seldom come again
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Chunks(dict):
    """What stands between two single spaces -> the ids of it and the space before it."""

    def __init__(self, encoder: "BytePairEncoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str):
        ids = self.encoder.joined(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[chunk] = ids
        return ids


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (r, len(b) - 1))
        self.automaton.make_automaton()
        self._prefix: dict[int, int] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.pieces, self.chunks = Pieces(self), Chunks(self)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self._prefix.get(token)
        if found is None:
            b = self.token[token]
            found = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
            self._prefix[token] = found
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            parts = self.merge(self.token[token], token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging by lowest rank, with ranks under `below` only; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves these two side by side."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self._walk(left, right)
        return known

    def _walk(self, left: int, right: int) -> bool:
        # Undo, latest merge first, the merges that made the tokens at the border. What
        # stands at the border then existed until the merge just undone (of rank `until`).
        # The two could have merged instead if their own merge ranks below that; at equal
        # rank the leftmost goes first, which favours the left token's own merge.
        until = float("inf")
        while True:
            joined = self.ranks.get(self.token[left] + self.token[right])
            if joined is not None and joined < until:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left, until = a[1], left
            else:
                right, until = b[0], right + 1

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        if n == 0:
            return []
        longest = [-1] * n
        for end, (rank, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = rank  # ends come in order, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        size, known, last, at, token = self.size, self._fits.get, -1, 0, longest[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if last < 0:
                        break
                    ok = known(last << 32 | token)
                    if ok or ok is None and self.fits(last, token):
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, at, token = token, end, longest[end]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = self.shorter(token)
            else:
                raise ValueError("the vocabulary lacks a byte")

    def joined(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text. Where white space stands in no runs, no match of the pattern
        crosses a space other than at its start, so the chunks between spaces are
        independent and their ids can be remembered."""
        if RUN.search(text):
            ids = self.joined(text)
        else:
            first, *rest = text.split(" ")
            ids = self.joined(first) + b"".join(map(self.chunks.__getitem__, rest))
        return np.frombuffer(ids, dtype=np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encoder(data: bytes, pattern: str) -> BytePairEncoder:
    """One encoder for each vocabulary and worker process."""
    return held("bpe", (hash(data), pattern), lambda: BytePairEncoder(read_ranks(data), pattern))


def _vocabulary(df: DataFrame, path: str | None):
    """The rank file's bytes as a broadcast: its size is that of a vocabulary, not of the data."""
    with open(path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Key and token ids (array<int>) of each row's whole text.

    A null or empty text has no ids. Repeated rows and null keys give a row each; columns
    besides key and text are not carried. Special tokens' strings are ordinary text.
    """
    bounded_batches(df.sparkSession)
    data, pat = _vocabulary(df, vocabulary), pattern or default_pattern()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(data.value, pat)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([enc.encode(t) for t in strings(b.column(1))])], names=[key, ids])

    return df.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, `{ids}` array<int>")


def encode_and_decode(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", out: str = "data", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode() and decode() of its ids in one pass over the texts: key, ids, and the bytes that the ids stand for."""
    bounded_batches(df.sparkSession)
    data, pat = _vocabulary(df, vocabulary), pattern or default_pattern()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(data.value, pat)
        for b in batches:
            found = [enc.encode(t) for t in strings(b.column(1))]
            back = pa.array([enc.decode(x.tolist()) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(found), back], names=[key, ids, out])

    return df.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, `{ids}` array<int>, `{out}` binary")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", out: str = "data", vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Key and the bytes that the ids stand for, with the named small columns beside; null ids give empty bytes."""
    bounded_batches(df.sparkSession)
    data, pat = _vocabulary(df, vocabulary), default_pattern()
    schema = ", ".join([f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (key, *carry)] + [f"`{out}` binary"])

    def run(batches):
        enc = encoder(data.value, pat)
        for b in batches:
            found = [enc.decode(x) if x else b"" for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=[key, *carry, out])

    return df.select(key, *carry, ids).mapInArrow(tidy(run), schema)
