"""Removal of repeated passages by prefix-free parsing.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier. Triggers are
places whose rolling hash over TRIGGER bytes is 0 mod 2^LEVELS. They cut a text into phrases, from
a trigger's start to the next one's end. Whether a place is a trigger depends on its TRIGGER
bytes alone, so no end of a phrase begins another (the parse is prefix-free), and equal windows
of LENGTH bytes have their first trigger at the same place: what lies before it in the window
is the end of a phrase, the rest is where the parse goes on. A window without a trigger takes
its first place with the most zero bits in place of one (so the insides of long phrases are cut
finer). Windows in a row with one trigger make one occurrence, a few for each hundred bytes.

1. Occurrences meet by trigger and content hash, once they have been thinned in their own task.
   Of equal ones all but the first are repeats as a whole, and so are the windows in them.
2. Where a trigger has different contents, these are looked up in the texts and combined, in a
   task for a number of triggers: the contents' phrases make a dictionary, in which each has a
   rank; what follows a trigger is a row of ranks, the parse. The suffix array of the parse is
   the order of its rows, with common prefixes from the dictionary; the suffix array of the
   dictionary, for phrases that end in one trigger, is their order read from the end, with
   common suffixes. Two windows are equal where both are common for long enough, so each window's
   first place in corpus order follows from the two arrays. Both are needed only among windows
   of one trigger, so no array spans the corpus.
3. Triggers that stand in very many different contents aren't gathered: their windows meet one
   by one, by hash, thinned in their own task before.

Removed ranges then meet the texts. Texts are sent only for documents that a filter of fixed
size lets through; where there are too many documents for it, all texts are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, cut, held, tidy

#: Bytes of a repeated string, and of a trigger. The hashes below are laid out for these two.
LENGTH, TRIGGER = 100, 32

#: Zero bits of a trigger's hash.
LEVELS = 5
SPAN = LENGTH - TRIGGER + 1  # places of a trigger in a window

#: Text bytes scanned at a time; occurrences thinned at a time; text bytes of a bucket.
CHUNK, FLUSH, BUCKET_BYTES = 1 << 19, 500_000, 48 << 20

#: Different phrases of a trigger, in one thinning and in all, up to which they are gathered.
LOCAL_PHRASES, PHRASES = 64, 4096

#: Contents combined at a time, about (whole triggers): each takes some 10 KB meanwhile.
CONTENTS_AT_ONCE = 8192

#: Bits of the broadcast filter of documents (6 MB), tasks that fill it, and the share of set bits beyond which it isn't used.
FILTER_BITS, FILTER_TASKS, FILTER_FULL = 48_000_000, 12, 0.6

_TABLE = np.random.default_rng(8).integers(1, 1 << 64, 256, dtype=np.uint64)
_PLACE_BITS = np.uint64(23)
_PLACE = np.uint64((1 << 23) - 1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

#: An occurrence: trigger hash, phrase hash, document, first window, windows after it, trigger's place after it.
OCCURRENCE = np.dtype([("k", "<u8"), ("x", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("more", "u1"), ("off", "u1")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
ASK = np.dtype([("k", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("more", "u1"), ("off", "u1"), ("hot", "u1")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i4")])

#: What a blob holds.
OCCURRENCES, RANGES, ASKS, HOT_KEYS, WINDOWS, CONTENTS = range(6)
TEXT = 9


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * _M1 + b
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
    return h


def _pack(a: np.ndarray) -> bytes:
    """A structured array field by field, compressed; sorted fields shrink most."""
    parts = []
    for n in a.dtype.names:
        f = np.ascontiguousarray(a[n])
        if n == "doc" and len(f):
            f = np.diff(f, prepend=np.int64(0))
        parts.append(f.tobytes())
    return len(a).to_bytes(4, "little") + zstandard.compress(b"".join(parts), 1)


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    out, raw, at = np.empty(n, kind), zstandard.decompress(data[4:]) if n else b"", 0
    for name in kind.names:
        t = kind[name]
        f = np.frombuffer(raw, t, n, at)
        out[name] = np.cumsum(f) if name == "doc" else f
        at += n * t.itemsize
    return out


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the 32 and of the 64 bytes from each place."""
    h = _TABLE[data]
    h32 = h
    for s in (1, 2, 4, 8, 16, 32):
        h32, h = h, _mix(h[:-s], h[s:]) if len(h) > s else h[:0]
    return h32, h


def _level(h32: np.ndarray) -> np.ndarray:
    """0 for a trigger, one more for each zero bit that a place's hash lacks to be one."""
    x = h32 | np.uint64(1 << LEVELS)
    zeros = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
    return np.uint64(LEVELS) - zeros.astype(np.uint64)


def scan(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of texts laid end to end (doc: the text's number), and both hashes of each place."""
    n = len(data)
    h32, h64 = _hashes(data)
    if n < LENGTH:
        return np.empty(0, OCCURRENCE), h32, h64
    doc = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, n)))
    c = _level(h32) << _PLACE_BITS | np.arange(len(h32), dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        c = np.minimum(c[:-s], c[s:])
    c = np.minimum(c[: n - LENGTH + 1], c[SPAN - 64 : SPAN - 64 + n - LENGTH + 1])
    place = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    trigger = (c[place] & _PLACE).astype(np.int64)
    if not len(place):
        return np.empty(0, OCCURRENCE), h32, h64
    new = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    first, last = place[new], place[np.append(new[1:], len(place)) - 1]
    t, end = trigger[new], last + LENGTH
    out = np.empty(len(new), OCCURRENCE)
    out["k"] = h32[t]
    size = end - first
    with np.errstate(over="ignore"):
        form = (size * 256 + (t - first)).astype(np.uint64)
        out["x"] = _mix(_mix(h64[first], h64[first + (size - 64) // 2]) ^ form, h64[end - 64])
    out["doc"], out["at"], out["more"], out["off"] = doc[first], first - starts[doc[first]], last - first, t - first
    return out, h32, h64


def _chunks(keys: list, texts: list[bytes]):
    """(keys, texts) of CHUNK bytes about; a longer text stands alone."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield keys[low:i], texts[low:i]
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield keys[low:], texts[low:]


def _scan_long(data: np.ndarray):
    """Occurrences of one text that is longer than places can be told apart: in overlapping parts."""
    step = int(_PLACE) // 2
    for low in range(0, max(1, len(data) - LENGTH + 1), step):
        part, _, _ = scan(data[low : low + step + LENGTH - 1], np.zeros(1, np.int64))
        part["at"] += low
        yield part


def occurrences(keys: list[int], texts: list[bytes]):
    for ks, ts in _chunks(keys, texts):
        sizes = np.array([len(t) for t in ts], np.int64)
        data = np.frombuffer(b"".join(ts), np.uint8)
        if len(data) > int(_PLACE):  # one long text
            parts = list(_scan_long(data))
            for p in parts:
                p["doc"] = ks[0]
                yield p
            continue
        if len(data) < LENGTH:
            continue
        found, _, _ = scan(data, np.cumsum(sizes) - sizes)
        found["doc"] = np.asarray(ks, np.int64)[found["doc"]]
        yield found


def _firsts(a: np.ndarray, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Masks over a: the first in corpus order among rows equal in both fields, and those equal to an earlier one."""
    first, later = np.ones(len(a), bool), np.zeros(len(a), bool)
    if not len(a):
        return first, later
    x, y = a[names[0]], a[names[1]]
    both = _mix(x, y)
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.append(s[1:] == s[:-1], False)
    some = order[same | np.append(False, same[:-1])]
    sub = a[some]
    o = np.lexsort((sub["at"], sub["doc"], sub[names[1]], sub[names[0]]))
    sub, some = sub[o], some[o]
    if len(sub):
        new = np.append(True, (sub[names[0]][1:] != sub[names[0]][:-1]) | (sub[names[1]][1:] != sub[names[1]][:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        # the same place again (a repeated row) isn't earlier
        tie = (sub["doc"] == sub["doc"][head]) & (sub["at"] == sub["at"][head])
        first[some], later[some] = new, ~tie
    return first, later


def _ranges(a: np.ndarray) -> np.ndarray:
    """Ranges of bytes that occurrences' windows cover, those of a document that touch as one."""
    if not len(a):
        return np.empty(0, RANGE)
    a = a[np.lexsort((a["at"], a["doc"]))]
    start, end = a["at"].astype(np.int64), a["at"].astype(np.int64) + (a["more"] if "more" in a.dtype.names else 0) + LENGTH
    return _union(a["doc"], start, end)


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges sorted by document and start, joined where they touch."""
    doc_new = np.append(True, doc[1:] != doc[:-1])
    number = np.cumsum(doc_new).astype(np.int64)
    reach = np.maximum.accumulate(end + (number << 33)) - (number << 33)
    new = doc_new | np.append(True, start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    out = np.empty(len(head), RANGE)
    out["doc"], out["start"] = doc[head], start[head]
    out["end"] = reach[np.append(head[1:], len(doc)) - 1]
    return out


def _dealt(a: np.ndarray, by: np.ndarray, buckets: int):
    """(bucket, rows) of a structured array, rows by document."""
    if not len(a):
        return
    b = (_mix(by.astype(np.uint64) if by.dtype != np.uint64 else by, np.uint64(7)) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((a["doc"], b)) if "doc" in a.dtype.names else np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    for low, high in zip(cuts, np.append(cuts[1:], len(a))):
        yield int(b[low]), a[low:high]


BLOB = "bucket int, kind int, data binary"
KEYS = np.dtype([("k", "<u8")])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


def _doc_hash(doc: np.ndarray) -> np.ndarray:
    return doc.view(np.uint64) if doc.flags.c_contiguous else np.ascontiguousarray(doc).view(np.uint64)


def _send(a: np.ndarray, kind: int, by: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(b, kind, _pack(rows)) for b, rows in _dealt(a, by, buckets)]


def _thin(a: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blobs of one thinning: what is decided here, triggers with too many phrases, and the rest by trigger."""
    first, later = _firsts(a, ("k", "x"))
    done = _ranges(a[later])
    rows = _send(done, RANGES, _doc_hash(done["doc"]), buckets)
    a = a[first]
    keys, counts = np.unique(a["k"], return_counts=True)
    hot = keys[counts > LOCAL_PHRASES]
    if len(hot):
        is_hot = np.isin(a["k"], hot)
        asks = _asks(a[is_hot], True)
        marks = np.empty(len(hot), KEYS)
        marks["k"] = hot
        rows += _send(asks, ASKS, _doc_hash(asks["doc"]), buckets) + _send(marks, HOT_KEYS, hot, buckets)
        a = a[~is_hot]
    return _batch(rows + _send(a, OCCURRENCES, a["k"], buckets))


def _asks(a: np.ndarray, hot) -> np.ndarray:
    out = np.empty(len(a), ASK)
    for n in ("k", "doc", "at", "more", "off"):
        out[n] = a[n]
    out["hot"] = hot
    return out


def _join(parts: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _decide(blobs: list[tuple[int, bytes]], buckets: int):
    """Of a bucket of triggers: repeats as ranges, and what has to be looked up, by document."""
    kinds = {OCCURRENCES: OCCURRENCE, RANGES: RANGE, ASKS: ASK, HOT_KEYS: KEYS}
    parts: dict[int, list] = {k: [] for k in kinds}
    for kind, data in blobs:
        if kind in (RANGES, ASKS):  # already by document
            yield (kind, data)
        else:
            parts[kind].append(_unpack(data, kinds[kind]))
    a = _join(parts[OCCURRENCES], OCCURRENCE)
    marked = np.unique(_join(parts[HOT_KEYS], KEYS)["k"])
    order = np.argsort(a["k"], kind="stable")
    k = a["k"][order]
    same = np.append(k[1:] == k[:-1], False) if len(k) else np.empty(0, bool)
    again = same | np.append(False, same[:-1]) if len(k) else same
    if len(marked):
        again |= np.isin(k, marked)
    a = a[order[again]]
    first, later = _firsts(a, ("k", "x"))
    yield (RANGES, _ranges(a[later]))
    a = a[first]
    keys, at, counts = np.unique(a["k"], return_inverse=True, return_counts=True)
    hot = np.isin(keys, marked) | (counts > PHRASES)
    keep = (counts[at] > 1) | hot[at] if len(a) else np.empty(0, bool)
    yield (ASKS, _asks(a[keep], hot[at][keep] if len(a) else 0))


def _sorted(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix (whole words wide), then by `more`."""
    words = np.ascontiguousarray(rows).view(">u8")
    return np.lexsort((*more[::-1], *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the rows of two byte matrices."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _cut_out(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Byte matrix of the `size` bytes from `begin` (or before it, backwards, with step -1); zeros after them."""
    i = np.arange(width)
    at = begin[:, None] + (i if step > 0 else -1 - i)
    return np.where(i < size[:, None], flat[np.clip(at, 0, len(flat) - 1)], 0).astype(np.uint8)


def dictionary(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of pieces of flat among their distinct ones, and those (a byte matrix and sizes), in order."""
    text = _cut_out(flat, begin, size, -(-LENGTH // 8) * 8)
    order = _sorted(text, size)
    t, n = text[order], size[order]
    new = np.append(True, (t[1:] != t[:-1]).any(axis=1) | (n[1:] != n[:-1]))[: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, t[new], n[new]


def parse_rows(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What follows each trigger, from begin on, as a row of its phrases' ranks (-1 after the last), and the dictionary."""
    m, end = len(begin), begin + size
    row = np.repeat(np.arange(m), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]
    h32, _ = _hashes(flat)
    inside = (place > begin[row]) & (place + TRIGGER <= end[row])
    starts = (place == begin[row]) | (inside & (_level(h32[np.minimum(place, len(h32) - 1)]) == 0))
    row, start = row[starts], place[starts]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    stop = np.where(last, end[row], np.append(start[1:], 0)[: len(row)] + TRIGGER)
    rank, text, sizes = dictionary(flat, start, stop - start)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    rows = np.full((m, int(number.max(initial=0)) + 1), -1, np.int64)
    rows[row, number] = rank
    return rows, text, sizes


def parse_order(key: np.ndarray, rows: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the parse by trigger, and each suffix's common prefix in bytes with the one before (-1: another trigger)."""
    order = np.lexsort((*(rows[:, i] for i in range(rows.shape[1] - 1, -1, -1)), key))
    r, k = rows[order], key[order]
    a, b = r[:-1], r[1:]
    differ = a != b
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1] - 1)
    each = np.where(b >= 0, sizes[np.maximum(b, 0)] - TRIGGER, 0)  # phrases overlap by a trigger
    before = (np.cumsum(each, axis=1) - each)[np.arange(len(at)), at]
    x, y = a[np.arange(len(at)), at], b[np.arange(len(at)), at]
    both = np.where((x >= 0) & (y >= 0), np.minimum(np.minimum(sizes[np.maximum(x, 0)], sizes[np.maximum(y, 0)]), _common(text[np.maximum(x, 0)], text[np.maximum(y, 0)])), TRIGGER)
    return order, np.append(-1, np.where(k[1:] == k[:-1], before + both, -1))


def dictionary_repeats(a: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Windows (doc, at) of the asked occurrences that an earlier one holds too, as ranges.

    a: the occurrences, contents: their bytes. Rows for the same place count once. Only windows of
    one trigger can be equal, so triggers are combined a number at a time.
    """
    order = np.argsort(a["k"], kind="stable")
    k, found, low = a["k"][order], [], 0
    while low < len(a):
        high = int(np.searchsorted(k, k[min(low + CONTENTS_AT_ONCE, len(k)) - 1], "right"))
        some = order[low:high]
        found.append(_triggers_repeats(a[some], [contents[i] for i in some]))
        low = high
    w = _join(found, RANGE)
    if len(found) < 2 or not len(w):
        return w
    w = w[np.lexsort((w["start"], w["doc"]))]
    return _union(w["doc"], w["start"].astype(np.int64), w["end"].astype(np.int64))


def _triggers_repeats(a: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """As dictionary_repeats, of some triggers in one go."""
    order = np.lexsort((a["at"], a["doc"], a["k"]))
    a, contents = a[order], [contents[i] for i in order]
    new = np.append(True, (a["doc"][1:] != a["doc"][:-1]) | (a["at"][1:] != a["at"][:-1]) | (a["k"][1:] != a["k"][:-1]))
    a, contents = a[new], [c for c, n in zip(contents, new) if n]
    order = np.lexsort((a["at"], a["doc"]))  # corpus order
    a, contents = a[order], [contents[i] for i in order]
    m = len(a)
    sizes = np.array([len(c) for c in contents], np.int64)
    flat = np.frombuffer(b"".join(contents), np.uint8)
    begin, off = np.cumsum(sizes) - sizes, a["off"].astype(np.int64)
    right_order, right_common = parse_order(a["k"], *parse_rows(flat, begin + off, sizes - off))
    ends = _cut_out(flat, begin + off, off, -(-SPAN // 8) * 8, -1)  # what stands before the trigger, read backwards
    left_order = _sorted(ends)
    left_common = np.append(-1, np.minimum(_common(ends[left_order[1:]], ends[left_order[:-1]]), SPAN))
    del ends
    low = off - a["more"]
    classes = np.empty(m, np.int64)
    found = []
    for before in range(SPAN):  # bytes of the window left of its trigger
        live = np.flatnonzero((low <= before) & (before <= off))
        if len(live) < 2:
            continue
        classes[right_order] = np.cumsum(right_common < LENGTH - before)
        mine = classes[live] * (m + 1)
        classes[left_order] = np.cumsum(left_common < before)
        mine += classes[live]
        _, first = np.unique(mine, return_index=True)
        later = np.ones(len(live), bool)
        later[first] = False
        hit = live[later]
        w = np.empty(len(hit), RANGE)
        w["doc"], w["start"] = a["doc"][hit], (a["at"][hit] + off[hit] - before)
        w["end"] = w["start"] + LENGTH
        found.append(w)
    w = _join(found, RANGE)
    if not len(w):
        return w
    w = w[np.lexsort((w["start"], w["doc"]))]
    return _union(w["doc"], w["start"].astype(np.int64), w["end"].astype(np.int64))


def _windows(ask: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row for each window of a document's hot occurrences."""
    more = ask["more"].astype(np.int64) + 1
    each = np.repeat(np.arange(len(ask)), more)
    at = ask["at"].astype(np.int64)[each] + np.arange(len(each)) - np.repeat(np.cumsum(more) - more, more)
    out = np.empty(len(at), WINDOW)
    base = ask["at"].astype(np.int64).min() if len(ask) else 0
    stop = int((at + LENGTH).max()) if len(at) else 0
    _, h64 = _hashes(data[base:stop])
    before = (ask["at"].astype(np.int64) + ask["off"])[each] - at
    out["a"] = _mix(ask["k"][each], before.astype(np.uint64))
    out["b"] = _mix(h64[at - base], h64[at - base + LENGTH - 64])
    out["doc"], out["at"] = ask["doc"][each], at
    return out


def _contents(asks: np.ndarray, pieces: list[bytes], buckets: int) -> list[tuple[int, int, bytes]]:
    rows = []
    if not len(asks):
        return rows
    b = (_mix(np.ascontiguousarray(asks["k"]), np.uint64(7)) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((asks["doc"], b))
    cuts = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1]))
    for low, high in zip(cuts, np.append(cuts[1:], len(order))):
        some = order[low:high]
        head = _pack(asks[some])
        rows.append((int(b[some[0]]), CONTENTS, len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join(pieces[i] for i in some), 1)))
    return rows


def _read_contents(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int.from_bytes(data[:4], "little")
    a = _unpack(data[4 : 4 + n], ASK)
    flat = zstandard.decompress(data[4 + n :])
    ends = np.cumsum(a["more"].astype(np.int64) + LENGTH)
    return a, [flat[e - s : e] for s, e in zip((a["more"].astype(np.int64) + LENGTH).tolist(), ends.tolist())]


def _concerned(a: np.ndarray) -> np.ndarray:
    """Sorted keys of a sorted-by-document structured array."""
    return np.unique(a["doc"])


class _Filter:
    """Keys of documents, as a Bloom filter."""

    HASHES = 5

    def __init__(self):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)

    def _at(self, keys: np.ndarray):
        x = _mix(keys.astype(np.int64).view(np.uint64), _M3)
        y = _mix(x, _M1) | np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(self.HASHES):
                at = (x + np.uint64(j) * y) % np.uint64(FILTER_BITS)
                yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        for at, bit in self._at(keys):
            np.bitwise_or.at(self.bits, at, bit)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at, bit in self._at(keys):
            out &= (self.bits[at] & bit) > 0
        return out


def _filter(info: DataFrame, kind: int):
    """A broadcast filter of the documents that blobs of a kind concern; None where they are too many for it."""
    form = {RANGES: RANGE, ASKS: ASK}[kind]

    def gather(batches):
        f, keys = _Filter(), [np.empty(0, np.int64)]
        for b in batches:
            keys += [_concerned(_unpack(d, form)) for d in b.column(0).to_pylist()]
            if len(keys) > 5000:
                keys = [np.unique(np.concatenate(keys))]
        f.add(np.unique(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(f.bits.tobytes(), 1)], pa.binary())], names=["bits"])

    out = _Filter()
    for r in info.filter(F.col("kind") == kind).select("data").coalesce(FILTER_TASKS).mapInArrow(tidy(gather), "bits binary").collect():  # FILTER_TASKS rows of fixed size
        out.bits |= np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    if int(np.bitwise_count(out.bits).sum(dtype=np.int64)) > FILTER_FULL * FILTER_BITS:
        return None
    return info.sparkSession.sparkContext.broadcast(out)


def _texts(keyed: DataFrame, buckets: int, concerned, carry: list[str]) -> DataFrame:
    """Compressed texts by document bucket, of the concerned documents."""
    schema = BLOB + ", key long" + "".join(f", `{c}` {keyed.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if concerned is not None:
                b = b.filter(pa.array(concerned.value.has(keys)))
                keys = b.column(0).to_numpy(zero_copy_only=False)
            bucket = ((_mix(keys.astype(np.int64).view(np.uint64), np.uint64(7)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            data = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(keys), TEXT, np.int32)), pa.array(data, pa.binary()), b.column(0), *b.columns[2:]], names=["bucket", "kind", "data", "key", *carry])

    return keyed.select("__doc", "__text", *carry).mapInArrow(tidy(run), schema)


def _meeting(info: DataFrame, texts: DataFrame, buckets: int, carry: list[str]) -> DataFrame:
    """Blobs and texts of each document bucket in one partition, blobs first."""
    info = info.select("*", F.lit(None).cast("long").alias("key"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in carry])
    return info.unionByName(texts).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")


def _held(batches, kinds: dict[int, np.dtype]):
    """Blobs gathered into arrays by document; then (batch of texts, arrays) for each batch with texts."""
    parts: dict[int, list] = {k: [] for k in kinds}
    arrays = None
    for b in batches:
        kind = b.column(1).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(np.isin(kind, list(kinds))):
            parts[int(kind[i])].append(_unpack(b.column(2)[int(i)].as_py(), kinds[int(kind[i])]))
        rows = np.flatnonzero(kind == TEXT)
        if len(rows):
            if arrays is None:
                arrays = {k: _join(parts[k], kinds[k]) for k in kinds}
                arrays = {k: a[np.argsort(a["doc"], kind="stable")] for k, a in arrays.items()}
                parts = {}
            yield b.take(pa.array(rows)), arrays


def _lookup(info: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """For what was asked: contents by trigger, and hot windows by hash."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        asked, pieces, hot, size, hot_n = [], [], [], 0, 0

        def out():
            rows = _contents(_join(asked, ASK), pieces, buckets)
            w = _join(hot, WINDOW)
            first, later = _firsts(w, ("a", "b"))
            done = _ranges(w[later])
            rows += _send(done, RANGES, _doc_hash(done["doc"]), buckets) + _send(w[first], WINDOWS, np.ascontiguousarray(w["b"][first]), buckets)
            asked.clear(), pieces.clear(), hot.clear()
            return _batch(rows)

        for b, arrays in _held(batches, {ASKS: ASK}):
            a = arrays[ASKS]
            keys = b.column(3).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(a["doc"], keys, "left"), np.searchsorted(a["doc"], keys, "right")
            for i in np.flatnonzero(high > low):
                mine = a[low[i] : high[i]]
                text = press.decompress(b.column(2)[int(i)].as_py())
                cold = mine[mine["hot"] == 0]
                asked.append(cold)
                pieces.extend(text[p : p + LENGTH + m] for p, m in zip(cold["at"].tolist(), cold["more"].tolist()))
                size += len(cold)
                warm = mine[mine["hot"] == 1]
                if len(warm):
                    hot.append(_windows(warm, np.frombuffer(text, np.uint8)))
                    hot_n += len(hot[-1])
                if size > 200_000 or hot_n > FLUSH:
                    yield out()
                    size = hot_n = 0
        yield out()

    return _meeting(info, texts, buckets, []).mapInArrow(tidy(run), BLOB)


def _collected(batches):
    blobs = []
    for b in batches:
        blobs += zip(b.column(1).to_pylist(), b.column(2).to_pylist())
    return blobs


def _resolve(asked: DataFrame, buckets: int) -> DataFrame:
    """Ranges, by document, of the windows that start earlier elsewhere."""

    def run(batches):
        rows, a, contents, windows = [], [], [], []
        for kind, data in _collected(batches):
            if kind == RANGES:
                some = _unpack(data, RANGE)
                rows += _send(some, RANGES, _doc_hash(some["doc"]), buckets)
            elif kind == CONTENTS:
                x, c = _read_contents(data)
                a.append(x)
                contents += c
            else:
                windows.append(_unpack(data, WINDOW))
        done = dictionary_repeats(_join(a, ASK), contents)
        rows += _send(done, RANGES, _doc_hash(done["doc"]), buckets)
        w = _join(windows, WINDOW)
        done = _ranges(w[_firsts(w, ("a", "b"))[1]])
        rows += _send(done, RANGES, _doc_hash(done["doc"]), buckets)
        yield _batch(rows)

    return asked.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), BLOB)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with __doc, a number that orders documents and differs for different texts, and __text."""
    doc = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    rows = df.withColumn("__doc", doc).withColumn("__text", F.col(text))
    told = rows.withColumns({"__null": F.col(key).isNull(), "__h": F.xxhash64(F.coalesce("__text", F.lit("")))})
    slim = told.select("__null", "__doc", "__h").distinct()
    if slim.groupBy("__doc").count().filter("count > 1").isEmpty():
        return rows
    # ranges of the whole order, so that one key's texts are spread; the ids rise with partition and place in it
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__null", "__doc", "__h"]
    numbers = cut(slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__number", F.monotonically_increasing_id()))
    return told.join(numbers, order).withColumn("__doc", F.col("__number")).select(*df.columns, "__doc", "__text")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """df's columns but the text, with __kept (its remaining bytes) and __spans (start and end of each removed run).

    as_text: __kept is a string, without the bytes of code points that were cut in two.

    Documents are ordered by key, null keys last. A null text is empty. A repeated row is no
    earlier document than its twin: both are judged alike. Different texts with one key follow
    each other in the order of a hash. Texts are UTF-8 bytes; matches never cross documents.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    keyed = _keyed(df, key, text)
    rest = [c for c in df.columns if c != text]
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def parse(batches):
        held("suffixes")
        parts, n = [], 0
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for found in occurrences(b.column(0).to_pylist(), texts):
                parts.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield _thin(np.concatenate(parts), buckets)
                    parts, n = [], 0
        if n:
            yield _thin(np.concatenate(parts), buckets)

    def decide(batches):
        blobs, rows = _collected(batches), []
        for kind, a in _decide(blobs, buckets):
            if isinstance(a, bytes):
                a = _unpack(a, RANGE if kind == RANGES else ASK)
            rows += _send(a, kind, _doc_hash(a["doc"]), buckets)
            if len(rows) > 5000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    first = cut(keyed.select("__doc", "__text").mapInArrow(tidy(parse), BLOB).repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(decide), BLOB))
    asked = first.filter(F.col("kind") == ASKS)
    looked = _lookup(asked, _texts(keyed, buckets, _filter(first, ASKS), []), buckets)
    info = cut(first.filter(F.col("kind") == RANGES).union(_resolve(looked, buckets)))
    concerned = _filter(info, RANGES)
    names = [f"__c{i}" for i in range(len(rest))]
    carried = keyed.select("__doc", "__text", *[F.col(c).alias(n) for c, n in zip(rest, names)])
    kinds = ", ".join(f"`{n}` {df.schema[c].dataType.simpleString()}" for c, n in zip(rest, names))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches):
        press = zstandard.ZstdDecompressor()
        for b, arrays in _held(batches, {RANGES: RANGE}):
            a = arrays[RANGES]
            keys = b.column(3).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(a["doc"], keys, "left"), np.searchsorted(a["doc"], keys, "right")
            kept, runs = [], []
            for i in range(b.num_rows):
                data = press.decompress(b.column(2)[i].as_py())
                mine = a[low[i] : high[i]]
                if len(mine):
                    mine = mine[np.argsort(mine["start"], kind="stable")]
                    u = _union(mine["doc"], mine["start"].astype(np.int64), mine["end"].astype(np.int64))
                    s, e = u["start"].tolist(), u["end"].tolist()
                    data = b"".join(data[x:y] for x, y in zip([0, *e], [*s, len(data)]))
                    runs.append([{"start": x, "end": y} for x, y in zip(s, e)])
                else:
                    runs.append([])
                kept.append(data.decode("utf-8", "ignore") if as_text else data)
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(runs, spans)], names=[*names, "__kept", "__spans"])

    kept_kind = "string" if as_text else "binary"
    out_schema = (kinds + ", " if kinds else "") + f"__kept {kept_kind}, __spans array<struct<start:bigint,end:bigint>>"
    texts = _texts(carried, buckets, concerned, names)
    changed = _meeting(info, texts, buckets, names).mapInArrow(tidy(remove), out_schema)
    if concerned is not None:
        whole = carried.filter(~_has(concerned)(F.col("__doc"))).select(*names, F.coalesce("__text", F.lit("")).cast(kept_kind).alias("__kept"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("__spans"))
        changed = changed.unionByName(whole)
    return changed.select(*[F.col(n).alias(c) for c, n in zip(rest, names)], "__kept", "__spans")


def _has(concerned):
    @F.arrow_udf("boolean")
    def has(keys: pa.Array) -> pa.Array:
        return pa.array(concerned.value.has(keys.to_numpy(zero_copy_only=False)))

    return has


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated passages taken out of its texts, all columns as they were.

    Bytes of a code point that is cut in two go with it; n_chars, where there is such a column,
    follows the text. A text without repeats stays as it is, null too. Columns may have any names.
    Null keys come last; repeated rows are judged alike; an empty table gives no rows.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*names.values())
    k, t, length = names[key], names[text], names.get("n_chars")
    got = remove_repeats(rows.withColumn("__was", F.col(t).isNull()), k, t, as_text=True)
    clean = F.when(F.col("__was"), F.lit(None)).otherwise(F.col("__kept"))
    got = got.withColumn("__clean", clean)
    types = {f.name: f.dataType for f in rows.schema}
    return got.select(*[F.col("__clean").alias(c) if c == t else F.length("__clean").cast(types[c]).alias(c) if c == length else F.col(c) for c in rows.columns]).toDF(*df.columns)
