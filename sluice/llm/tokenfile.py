"""Token ids in files, by an adaptive context-mixing range coder.

A segment holds whole documents, in ascending order of their keys: their keys and lengths, a
prior, and their ids in blocks of about BLOCK_IDS. Each block is coded on its own, from models
reset to the prior, and has a checksum, so that a damaged block is found and spoils no other.
All blocks of a segment are coded side by side, one lane of numpy arrays each.

The prior is what a block starts from: how often each id stands in the segment (order 0) and
which id follows each most often (order 1, from all pairs). In a lane
the order-2 model learns which id came last after the two before. For each id the order-2 guess,
or the order-1 guess where there is none, is coded as right or wrong, with a probability mixed
in the logistic domain, by weights that learn, from what the orders 2, 1 and 0 give the guessed
id: counters of the guesses' trust that learn in the lane, and the id's own probability. An
order-1 guess that differs is tried next; an id that wasn't guessed is coded whole by its
order-0 probability. All drive a 32-bit range coder with carries.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, held, shared_folder, tidy
from sluice.llm.syncmers import range_of, ranges

MAGIC, VERSION = b"SLTK", 2

#: Ids of a block and of a segment, about; rows of a range of keys, about.
BLOCK_IDS, SEGMENT_IDS = 4096, 6 << 20
RANGE_ROWS = 4000

#: Slots of a lane's order-2 guesses, and the least times that a pair of the order-1 prior is seen.
SLOTS, SEEN = 2048, 3

#: Bits of a mixed probability, and of an order-0 one. Grades of trust in an order-1 guess.
P_BITS, ID_BITS, GRADES = 12, 16, 16

#: Chunks of text whose ids a worker remembers at most.
MEMO_CHUNKS = 1_000_000

_one = 1 << P_BITS
_x = (np.arange(_one) + 0.5) / _one
_STRETCH = np.rint(np.log(_x / (1 - _x)) * 256).astype(np.int32)
_SQUASH = np.clip(np.rint(_one / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, _one - 32).astype(np.int32)
_LOW = np.uint64(0xFFFFFFFF)
_HALF, _S16, _S32 = np.uint64(1 << 16), np.uint64(16), np.uint64(32)


class _Out:
    """Range encoders, one for each lane."""

    def __init__(self, lanes: int, ids: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFF, np.uint64)
        self.words, self.at = np.zeros((lanes, 2 * ids + 16), np.uint16), np.zeros(lanes, np.int64)

    def _settle(self) -> None:
        over = np.flatnonzero(self.low > _LOW)
        if len(over):
            self.low[over] &= _LOW
            place = self.at[over] - 1
            while len(over):  # carry into what has been written
                w = self.words[over, place] + np.uint16(1)
                self.words[over, place] = w
                more = w == 0
                over, place = over[more], place[more] - 1
        short = np.flatnonzero(self.range < _HALF)
        if len(short):
            self._write(short)
            self.range[short] <<= _S16

    def _write(self, lanes) -> None:
        if self.at.max() + 2 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        low = self.low[lanes]
        self.words[lanes, self.at[lanes]] = (low >> _S16).astype(np.uint16)
        self.at[lanes] += 1
        self.low[lanes] = (low << _S16) & _LOW

    def bit(self, p, hit) -> None:
        bound = (self.range >> np.uint64(P_BITS)) * p.astype(np.uint64)
        self.low += np.where(hit, np.uint64(0), bound)
        self.range = np.where(hit, bound, self.range - bound)
        self._settle()

    def bit_of(self, lanes, p, hit) -> None:
        r = self.range.take(lanes)
        bound = (r >> np.uint64(P_BITS)) * p.astype(np.uint64)
        self.low[lanes] += np.where(hit, np.uint64(0), bound)
        self.range[lanes] = np.where(hit, bound, r - bound)
        self._settle()

    def symbol(self, lanes, start, size) -> None:
        r = self.range.take(lanes) >> np.uint64(ID_BITS)
        self.low[lanes] += r * start
        self.range[lanes] = r * size
        self._settle()

    def close(self) -> list[bytes]:
        every = np.arange(len(self.low))
        self._write(every)
        self._write(every)
        return [w[:n].astype("<u2").tobytes() for w, n in zip(self.words, self.at.tolist())]


class _In:
    """Range decoders, one for each lane."""

    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) // 2 for b in blocks], np.int64)
        self.words = np.frombuffer(b"".join(blocks) + b"\0" * 8, "<u2").astype(np.uint64)
        self.at = np.cumsum(sizes) - sizes
        self.code = self.words[self.at] << _S16 | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(len(blocks), 0xFFFFFFFF, np.uint64)

    def _settle(self) -> None:
        short = np.flatnonzero(self.range < _HALF)
        if len(short):
            at = np.minimum(self.at[short], len(self.words) - 1)
            self.code[short] = self.code[short] << _S16 | self.words[at]
            self.at[short] += 1
            self.range[short] <<= _S16

    def bit(self, p, _) -> np.ndarray:
        bound = (self.range >> np.uint64(P_BITS)) * p.astype(np.uint64)
        hit = self.code < bound
        self.code = np.where(hit, self.code, self.code - bound)
        self.range = np.where(hit, bound, self.range - bound)
        self._settle()
        return hit

    def bit_of(self, lanes, p, _) -> np.ndarray:
        r, c = self.range.take(lanes), self.code.take(lanes)
        bound = (r >> np.uint64(P_BITS)) * p.astype(np.uint64)
        hit = c < bound
        self.code[lanes] = np.where(hit, c, c - bound)
        self.range[lanes] = np.where(hit, bound, r - bound)
        self._settle()
        return hit

    def value(self, lanes) -> np.ndarray:
        """Where the next symbol's range lies, in 2^ID_BITS parts."""
        self.part = self.range.take(lanes) >> np.uint64(ID_BITS)
        return np.minimum(self.code.take(lanes) // self.part, np.uint64((1 << ID_BITS) - 1)).astype(np.int64)

    def symbol(self, lanes, start, size) -> None:
        self.code[lanes] -= self.part * start
        self.range[lanes] = self.part * size
        self._settle()


@dataclass(frozen=True)
class Prior:
    """What the blocks of a segment start from."""

    ids: np.ndarray  # those with an order-0 probability of their own, ascending
    parts: np.ndarray  # of 2^ID_BITS, one for each of them and one, at least 1, for all others
    after: np.ndarray  # ids, ascending, whose follower is guessed
    follower: np.ndarray
    grade: np.ndarray  # 1 to GRADES - 1: how often it follows
    top: int  # the largest id

    @classmethod
    def of(cls, ids: np.ndarray) -> "Prior":
        n, top = max(1, len(ids)), int(ids.max(initial=0))
        found, counts = np.unique(ids, return_counts=True)
        whole = 1 << ID_BITS
        kept = np.flatnonzero(counts * 2.0 * whole >= n)
        kept = np.sort(kept[np.argsort(-counts[kept], kind="stable")][: whole // 2])
        found, counts = found[kept], counts[kept]
        other = max(1, round((n - int(counts.sum())) / n * whole))
        parts = np.maximum(1, counts * float(whole - other - len(found)) / max(1, int(counts.sum()))).astype(np.int64)
        if len(parts):
            parts[int(parts.argmax())] += whole - other - int(parts.sum())
        else:
            other = whole
        pairs, times = np.unique(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64), return_counts=True)
        before = pairs >> np.uint64(32)
        all_of = np.zeros(len(pairs), np.int64)
        order = np.lexsort((-times, before))
        head = np.flatnonzero(np.append(True, before[order][1:] != before[order][:-1]))[: len(order)]
        best = order[head]
        if len(order):
            all_of = np.add.reduceat(times[order], head)
        use = times[best] >= SEEN
        best, share = best[use], (times[best] / np.maximum(all_of[: len(best)], 1))[use] if len(order) else np.empty(0)
        return cls(found.astype(np.int64), np.append(parts, other), before[best].astype(np.int64), (pairs[best] & _LOW).astype(np.int64), 1 + np.minimum(GRADES - 2, share * (GRADES - 1)).astype(np.int64), top)

    def write(self) -> bytes:
        head = np.array([len(self.ids), len(self.after), self.top], "<u4").tobytes()
        columns = [np.diff(self.ids, prepend=0), self.parts, np.diff(self.after, prepend=0), self.follower, self.grade]
        return zlib.compress(head + b"".join(c.astype("<u4").tobytes() for c in columns), 6)

    @classmethod
    def read(cls, data: bytes) -> "Prior":
        a = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        n, m, top = a[:3].tolist()
        ids, parts, after, follower, grade = np.split(a[3:], np.cumsum([n, n + 1, m, m]))
        return cls(np.cumsum(ids), parts, np.cumsum(after), follower, grade, top)

    def tables(self) -> tuple:
        """By id: start and part of its range (or of that of all others, if it has none of its `own`), its stretched probability, follower and grade; by place: the id, -1 for all others."""
        n = max(self.top, int(self.follower.max(initial=0))) + 1
        starts = np.cumsum(self.parts) - self.parts
        start, part, own = np.full(n, starts[-1], np.uint64), np.full(n, self.parts[-1], np.uint64), np.zeros(n, bool)
        start[self.ids], part[self.ids], own[self.ids] = starts[:-1], self.parts[:-1], True
        p = np.clip(part.astype(float) / (1 << ID_BITS), 1 / (1 << ID_BITS), 0.99)
        stretched = np.where(own, np.rint(np.log(p / (1 - p)) * 256), -2047).astype(np.int32)
        follower, grade = np.zeros(n, np.int64), np.zeros(n, np.int64)
        follower[self.after], grade[self.after] = self.follower, self.grade
        place = np.repeat(np.append(self.ids, -1), self.parts)
        return start, part, own, stretched, follower, grade, place


def _learn(entry: np.ndarray, guess: np.ndarray, trust: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A slot's next state: a guess gains trust, loses half, or is replaced."""
    right = (guess == ids) & (trust > 0)
    return np.where(right, entry + (trust < 7), np.where(trust > 1, entry - (trust + 1 >> 1), ids << 3 | 1))


def _code(coder, lanes: int, steps: int, prior: Prior, ids: np.ndarray | None) -> np.ndarray | None:
    """Codes (ids: steps x lanes) or, with ids None, decodes and returns them."""
    decode = ids is None
    got = np.zeros((steps, lanes), np.int64) if decode else None
    start, part, own, stretched, follower, grade, place = prior.tables()
    start_others, part_others = np.uint64((1 << ID_BITS) - int(prior.parts[-1])), np.uint64(prior.parts[-1])
    top_bytes = max(1, -(-int(prior.top).bit_length() // 16))
    every = np.arange(lanes)
    base, base16, base32 = every * SLOTS, every * 16, every * 2 * GRADES
    slots = np.zeros(lanes * SLOTS, np.int32 if len(follower) < 1 << 28 else np.int64)
    # what a guess of each trust is worth until the lane knows better
    trust2 = np.tile(np.rint(_one * np.append([0.02, 0.25, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], [0.02, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])).astype(np.int32), lanes)
    worth = (np.arange(GRADES) - 0.5).clip(0.02 * GRADES) / (GRADES - 1)
    trust1 = np.tile(np.clip(np.rint(_one * np.append(worth, worth)), 32, _one - 32).astype(np.int32), lanes)
    second = np.tile(np.clip(np.rint(_one * worth), 32, _one - 32).astype(np.int64), lanes)
    weight2, weight1, weight0 = np.full(lanes, 30_000, np.int64), np.full(lanes, 36_000, np.int64), np.zeros(lanes, np.int64)
    b1, b2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    hit_of, one = np.array([0, _one], np.int64), np.uint64(1)
    for step in range(steps):
        i2 = base + ((b1 * 0x9E3779B1 ^ b2 * 0x85EBCA77) >> 9 & SLOTS - 1)
        entry = slots.take(i2)
        g2, q2 = entry >> 3, entry & 7
        g1, q1 = follower.take(b1), grade.take(b1)
        first = np.where(q2 > 0, g2, g1)
        agree = g1 == g2
        j2, j1 = base16 + q2 + agree * 8, base32 + q1 + agree * GRADES
        c2, c1 = trust2.take(j2), trust1.take(j1)
        s2, s1, s0 = _STRETCH.take(c2), _STRETCH.take(c1), stretched.take(first)
        z = weight2 * s2 + weight1 * s1 + weight0 * s0 >> 16
        p = _SQUASH.take(np.minimum(np.maximum(z, -2047), 2047) + 2047)
        if decode:
            hit = coder.bit(p, None)
            x = np.where(hit, first, 0)
        else:
            x = ids[step]
            hit = x == first
            coder.bit(p, hit)
        goal = hit.astype(np.int32) << P_BITS
        error = goal - p
        weight2 += s2 * error >> 8
        weight1 += s1 * error >> 8
        weight0 += s0 * error >> 10
        trust2[j2] = c2 + (goal - c2 >> 4)
        trust1[j1] = c1 + (goal - c1 >> 4)
        left = ~hit
        two = np.flatnonzero(left & (q1 > 0) & (q2 > 0) & ~agree)
        if len(two):
            j = two * GRADES + q1[two]
            c = second[j]
            p = np.minimum(np.maximum(c, 32), _one - 32)
            if decode:
                h = coder.bit_of(two, p, None)
                x[two[h]] = g1[two[h]]
            else:
                h = x[two] == g1[two]
                coder.bit_of(two, p, h)
            second[j] = c + (hit_of[h.view(np.int8)] - c >> 4)
            left[two[h]] = False
        rest = np.flatnonzero(left)
        if len(rest):
            if decode:
                value = place.take(coder.value(rest))
                some = np.maximum(value, 0)
                other = value < 0
                coder.symbol(rest, np.where(other, start_others, start[some]), np.where(other, part_others, part[some]))
                x[rest] = value
            else:
                value = x.take(rest)
                coder.symbol(rest, start.take(value), part.take(value))
                other = ~own.take(value)
            far = rest[other]
            if len(far):  # an id without a probability of its own: its bits
                value = np.zeros(len(far), np.int64) if decode else x[far]
                for w in range(top_bytes - 1, -1, -1):
                    if decode:
                        v = coder.value(far)
                        value = value << 16 | v
                    else:
                        v = value >> 16 * w & 0xFFFF
                    coder.symbol(far, v.astype(np.uint64), one)
                if decode:
                    x[far] = value
        if decode:
            got[step] = x
            x = np.minimum(x, len(follower) - 1)  # a damaged block may give any id
        slots[i2] = _learn(entry, g2, q2, x)
        b2, b1 = b1, x
    return got


def encode_segment(keys: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """A segment's bytes: head, documents' keys and sizes, prior, blocks' sizes and checksums, blocks."""
    n = len(ids)
    lanes = -(-n // BLOCK_IDS)
    prior, blocks, sums = Prior.of(ids), [], []
    if lanes:
        steps = -(-n // lanes)
        short = lanes * steps - n  # the last lanes have an id less
        cuts = np.concatenate([np.arange(lanes - short) * steps, (lanes - short) * steps + np.arange(short) * (steps - 1)])
        index = np.minimum(cuts + np.arange(steps)[:, None], n - 1)
        coder = _Out(lanes, steps)
        _code(coder, lanes, steps, prior, ids.astype(np.int64)[index])
        blocks = coder.close()
        raw = ids.astype("<u4").tobytes()
        ends = np.append(cuts[1:], n)
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist())]
    head = json.dumps({"ids": n, "documents": len(keys), "lanes": lanes}).encode()
    index = zlib.compress(json.dumps([keys, sizes]).encode(), 1)
    table = np.array([[len(b) for b in blocks], sums], "<u4").tobytes() if lanes else b""
    parts = [MAGIC, bytes([VERSION]), *(x for p in (head, index, prior.write() if lanes else b"", table) for x in (len(p).to_bytes(4, "little"), p)), *blocks]
    return b"".join(parts)


def decode_segment(data: bytes) -> tuple[list, list[int], np.ndarray]:
    """Keys, sizes and ids; raises ValueError with the number of the first damaged block."""
    if data[:4] != MAGIC or data[4] != VERSION:
        raise ValueError("not a segment of token ids")
    at, parts = 5, []
    for _ in range(4):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    head = json.loads(parts[0])
    keys, sizes = json.loads(zlib.decompress(parts[1]))
    n, lanes = head["ids"], head["lanes"]
    if not lanes:
        return keys, sizes, np.empty(0, np.uint32)
    lengths, sums = np.frombuffer(parts[3], "<u4").reshape(2, lanes)
    ends = at + np.cumsum(lengths.astype(np.int64))
    blocks = [data[e - s : e] for e, s in zip(ends.tolist(), lengths.tolist())]
    steps = -(-n // lanes)
    got = _code(_In(blocks), lanes, steps, Prior.read(parts[2]), None)
    short = lanes * steps - n
    full = lanes - short
    ids = np.concatenate([got[:, :full].T.ravel(), got[: steps - 1, full:].T.ravel()]).astype("<u4")
    raw, low = ids.tobytes(), 0
    for i in range(lanes):
        high = low + steps - (i >= full)
        if zlib.crc32(raw[4 * low : 4 * high]) != sums[i]:
            raise ValueError(f"block {i} is damaged")
        low = high
    return keys, sizes, ids


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks(dict):
    """Text between spaces -> ids as bytes. The tokenizer never joins what white space parts.

    A plain word, of composed letters that lower-case one by one, is looked up in lower case and
    without its closing punctuation, which is a piece of its own. Plain words go to the tokenizer
    many in a line: each of them ends with an id that ends a word, so the line's ids fall apart
    into the words' again.
    """

    LINE, LETTERS, MARKS = 2000, "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?"

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        words = self.tokenizer.get_vocab()
        #: strings of added tokens, which the library looks for before anything parts the text, each after its longest part without letters
        self.added = [(max(re.findall(r"[^\w]*", t.content), key=len), re.compile(re.escape(t.content), re.I if t.normalized else 0)) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.is_plain = re.compile(f"[{self.LETTERS}]+").fullmatch

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> None:
        for low in range(0, len(words), self.LINE):
            some = words[low : low + self.LINE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                self.update(zip(some, (raw[x:y] for x, y in zip([0, *cuts], cuts))))
            else:
                self.update(zip(some, self._encode(some)))

    def _found(self, kinds: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        got = list(map(self.get, kinds))
        new = [c for c, x in zip(kinds, got) if x is None]
        if new:
            if len(self) + len(new) > MEMO_CHUNKS:
                self.clear()
            plain = list(filter(self.is_plain, new))
            self._lines(plain)
            other = [c for c in new if not self.is_plain(c)] if len(plain) < len(new) else []
            self.update(zip(other, self._encode(other)))
            got = [self[c] if x is None else x for c, x in zip(kinds, got)]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (32 bits each) of each text."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Ids (binary, 32 bits each) of each text, then `tail`; a text that holds an added token's string goes to the library whole."""
        texts = texts.cast(pa.string()).fill_null("")
        whole = np.zeros(len(texts), bool)
        for part, string in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, part).to_numpy(zero_copy_only=False)).tolist():
                whole[i] = whole[i] or bool(string.search(texts[i].as_py()))
        if whole.any():
            given = iter(self._encode(texts.filter(pa.array(whole)).to_pylist()))
            rest = iter(self.encode_array(texts.filter(pa.array(~whole)), tail).to_pylist())
            return pa.array([next(given) + tail if w else next(rest) for w in whole.tolist()], pa.binary())
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        cuts = np.asarray(chunks.offsets, np.int64)
        chunk = chunks.flatten().dictionary_encode()
        # each kind of chunk is a stem, lower-cased if plain, and the marks after a plain one
        plain = pc.match_substring_regex(chunk.dictionary, f"^[{self.LETTERS}]+[{self.MARKS}]*$")
        bare = pc.utf8_rtrim(chunk.dictionary, self.MARKS)
        stem = pc.if_else(plain, pc.utf8_lower(bare), chunk.dictionary).dictionary_encode()
        marks = pc.if_else(plain, chunk.dictionary, "")
        marks = pc.replace_substring_regex(marks, f"^[{self.LETTERS}]+", "").dictionary_encode()
        stems = stem.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*self._found(stems), *self._encode(marks.dictionary.to_pylist()), tail]
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        pairs = np.stack([stem.indices.to_numpy(), marks.indices.to_numpy() + len(stems)], 1).astype(np.int64)
        piece = np.insert(pairs[chunk.indices.to_numpy()].ravel(), 2 * (cuts[1:] - cuts[0]), len(ids) - 1)
        count = sizes[piece]
        ends = np.cumsum(count)
        got = flat[np.repeat(starts[piece] - ends + count, count) + np.arange(count.sum())]
        bounds = 4 * np.append(0, ends[2 * (cuts[1:] - cuts[0]) + np.arange(len(texts))])
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(got)]).cast(pa.binary())


def _chunks(vocabulary: str) -> Chunks:
    return held("tokens", hash(vocabulary), lambda: Chunks(vocabulary))


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int | None = None) -> DataFrame:
    """Key and ids (binary, 32 bits each, little-endian) of each whole text, of any length, `end` appended.

    Null counts as empty; repeated rows and null keys give a row each; an empty table gives no
    rows; other columns are not carried.
    """
    bounded_batches(df.sparkSession)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's size
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches):
        chunks = _chunks(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), chunks.encode_array(b.column(1), tail)], names=[key, "ids"])

    return df.select(key, text).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary")


def write(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", tops: list[int] | None = None) -> None:
    """Files of segments in ascending order of integer keys, null keys last; ids: binary, 32 bits each.

    Rows are dealt into ranges of keys, a task and file each. path holds one row a segment: its
    range, its number in it, the ids before it in the range, those it has, its bytes. tops:
    the ranges' largest keys, where they are known from a table that is cheaper to read. Repeated
    rows are written each, null ids as none, an empty table as no segments; a text of any length
    stands in one segment; other columns are not written. The files stay until the caller removes them.
    """
    bounded_batches(df.sparkSession)
    tops = ranges(df, key, RANGE_ROWS) if tops is None else tops
    last = max(0, len(tops) - 1)
    k = F.col(key).cast("long")
    place = F.when(k.isNull() | F.lit(not tops), last).otherwise(F.least(range_of(k, tops)[0], F.lit(last)))
    rows = df.select(k.alias("k"), k.isNull().alias("null"), F.col(ids).alias("ids"), place.alias("range"))
    rows = rows.repartitionById(last + 1, F.col("range")).sortWithinPartitions("range", "null", "k", "ids")

    def pack(batches):
        held("segments")
        keys, parts, sizes, number, where, n, sum_ids, inside = [], [], [], 0, 0, 0, 0, 0

        def out():
            flat = np.frombuffer(b"".join(parts), "<u4")
            row = pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([number], pa.int32()), pa.array([inside], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([encode_segment(keys, sizes, flat)], pa.binary())], names=["range", "number", "inside", "n", "segment"])
            keys.clear(), parts.clear(), sizes.clear()
            return row

        for b in batches:
            for k, null, data, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                if n and (n > SEGMENT_IDS or r != where):
                    yield out()
                    number, inside = (number + 1, inside + sum_ids) if r == where else (0, 0)
                    n = sum_ids = 0
                where = r
                keys.append(None if null else k)
                parts.append(data or b"")
                sizes.append(len(parts[-1]) // 4)
                n += sizes[-1] or 1
                sum_ids += sizes[-1]
        if n:
            yield out()

    rows.select("k", "null", "ids", "range").mapInArrow(tidy(pack), "range int, number int, inside long, n long, segment binary").write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, start (ids of all rows before) and ids (binary) of each row, from the files' bytes; no segments give no rows."""
    bounded_batches(spark)
    files = spark.read.parquet(path)
    sums = {r["range"]: r["n"] for r in files.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row for each range of keys
    before, total = [], 0
    for r in sorted(sums):
        before.append((r, total))
        total += sums[r]
    offsets = spark.createDataFrame(before or [(0, 0)], "range int, before long")  # MOST_RANGES rows at most
    placed = files.join(F.broadcast(offsets), "range").select((F.col("before") + F.col("inside")).alias("start"), "segment")

    def run(batches):
        held("segments")
        for b in batches:
            for i in range(b.num_rows):
                keys, sizes, ids = decode_segment(b.column(1)[i].as_py())
                ends = np.cumsum(np.array(sizes, np.int64))
                at = b.column(0)[i].as_py() + ends - np.array(sizes, np.int64)
                raw = ids.tobytes()
                for low in range(0, len(keys), 500):
                    high = min(low + 500, len(keys))
                    cut = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends[low:high].tolist(), sizes[low:high])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[low:high], pa.int64()), pa.array(at[low:high], pa.int64()), pa.array(cut, pa.binary())], names=[key, "start", "ids"])

    return placed.mapInArrow(tidy(run), f"`{key}` long, start long, ids binary")


def store(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int | None = None) -> DataFrame:
    """Tokenizes, writes the files (in the shared folder where no path is given) and reads them back.

    Rows as tokenize, write and read have them. The rows returned are read from the files, which
    the caller removes when it has done with them.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(tokenize(df, key, text, vocabulary, end), path, key, tops=ranges(df, key, RANGE_ROWS))
    return read(spark, path, key)
