"""Near copies: texts whose sets of word shingles have a Jaccard index of p/q or more.

SimHash with pigeonring filtering searches them; shingle by shingle comparison decides.

1. Each distinct shingle set has a wide SimHash fingerprint of BITS bits: the signs of BITS
   orthogonal +-1 planes over its shingles. Two sets of the index 0.8 differ in 15.2 % of the
   bits on average, the budget allows MOST of them (19 %).
2. The bits lie on RINGS rings, each a seeded order of all bits in segments of SEGMENT bits.
   A chain of consecutive segments may differ in its proportional part of the budget. The
   chain's first segment must be equal: it is the key under which candidates meet. Longer
   chains prune the candidates of a key; the full distance is checked after them.
   Within the budget the pigeonring principle promises a chain, but one whose first segment
   differs in up to SEGMENT * MOST / BITS bits; that the first segment is equal is a matter of
   chance; step 6 finds what is missed.
   Keys of SEGMENT bits, not of the six that the promise would leave, keep unlike texts apart.
3. Sets of fewer than FEW shingles (their bits are coarse) meet by their first shingles too: of
   two sets with the index p/q each has a common one among its first n - ceil(n * p / q) + 1 in
   one order of all shingles.
4. Under a key as many candidates are sent on as keep its alike rows connected, by the most
   alike, and each row's NEAREST most alike, never all pairs.
5. Candidates are compared shingle by shingle, first some of the best of each text, then all
   that are left between the groups which these make. Only these comparisons link.
6. What the search may have missed comes from an exact prefix filter: of two sets with the index
   p/q each has a common shingle among its first n - ceil(n * p / q) + 1 in one order of all
   shingles (the frequent ones last). Sets that meet so, that sizes, the shingles' places and the number
   of first shingles in common allow the index, and that aren't in one group yet, are all
   compared, with no cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, column, cut, filter_of, held, let_go, passing, strings, tidy
from sluice.llm.graph import components
from sluice.llm.simhash import SEED, hashes

WORDS, LEAST = 5, (4, 5)

#: Bits of a wide fingerprint, of a segment, segments of a ring, rings, and differing bits at most.
BITS, SEGMENT, SEGMENTS, RINGS, MOST = 1024, 24, 42, 2, 192

#: Shingles of a set below which it meets by shingles too; differing bits of 128 that then are allowed.
FEW, FEW_MOST = 24, 48

#: Most alike rows of a key that each row is sent on with; rows of a key up to which pairs are found by shifts, and up to which they are held.
NEAREST, SHIFTS, HELD = 1, 48, 3000

#: Candidates of a text that are compared first, the best of so many parts of all it has.
CHOICES = 8

#: Shingles counted at a time, least count there of one that is told of, and frequent shingles that the order knows at most (it alone depends on them, no result).
COUNTED, OFTEN, FREQUENT = 2_000_000, 4, 500_000

#: Bytes of a first shingle that is a key; two shingles of one key only add to what is compared.
KEY_BYTES = 5

#: Keys of a bucket about, sets whose keys are packed at a time, rows compared at a time.
BUCKET_KEYS, FLUSH, CHUNK = 1_000_000, 4000, 50_000

_ORDERS = np.stack([np.random.default_rng([SEED, r]).permutation(BITS)[: SEGMENT * SEGMENTS] for r in range(RINGS)])
_BY_SHINGLE = RINGS * SEGMENTS  # what marks a key that is a shingle

BLOB, EDGE = "bucket int, data binary", "u long, v long, d int"


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The set's hashes, ascending."""
    return np.unique(hashes(text, words))


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (rows of BITS / 8 bytes): signs of a Hadamard transform of signed counts of the shingles."""
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for low in range(0, len(sets), 256):
        some = sets[low : low + 256]
        m, flat = len(some), np.concatenate([np.empty(0, np.uint64), *some])
        row = np.repeat(np.arange(m), [len(s) for s in some])
        sign = 1.0 - 2.0 * (flat >> np.uint64(10) & np.uint64(1)).astype(np.float64)
        x = np.bincount(row * BITS + (flat & np.uint64(BITS - 1)).astype(np.int64), weights=sign, minlength=m * BITS).astype(np.float32)
        step = 1
        while step < BITS:
            y = x.reshape(m, -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
            step *= 2
        out[low : low + 256] = np.packbits(x.reshape(m, BITS) > 0, axis=1)
    return out


def ring_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint and segment: the key (ring and segment above its bits) and, in two words, 128 bits of the six segments after it."""
    bits = np.unpackbits(prints, axis=1)
    keys, after = [], []
    for r, order in enumerate(_ORDERS):
        three = np.packbits(bits[:, order].reshape(len(bits), SEGMENTS, SEGMENT), axis=2).astype(np.uint64)
        part = three[:, :, 0] << np.uint64(16) | three[:, :, 1] << np.uint64(8) | three[:, :, 2]
        keys.append(np.uint64(r * SEGMENTS) + np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(32) | part)
        words = []
        for i in (1, 4):
            a, b, c = (np.roll(part, -j, axis=1) for j in (i, i + 1, i + 2))
            words.append(a | b << np.uint64(24) | (c >> np.uint64(8)) << np.uint64(48))
        after.append(np.stack(words, axis=2))
    return np.concatenate(keys, axis=1), np.concatenate(after, axis=1)


def _chains(x: np.ndarray, by_shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which differences x of the bits after a key are within the budgets of all chains, and how many bits differ."""
    each = np.bitwise_count(x).astype(np.int64)
    d = each[..., 0] + each[..., 1]
    ok = (d * BITS <= MOST * (SEGMENT + 128)) & (each[..., 0] * BITS <= MOST * (SEGMENT + 64))
    for bits in (24, 48):
        ok &= np.bitwise_count(x[..., 0] & np.uint64((1 << bits) - 1)).astype(np.int64) * BITS <= MOST * (SEGMENT + bits)
    return np.where(by_shingle, d <= FEW_MOST, ok), d


def _sparse(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of links a-b with distances d: which make up a forest by the least distances, or are among a row's NEAREST."""
    if not len(a):
        return np.zeros(0, bool)
    order = np.lexsort((b, a, d))
    rows, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    rank, n = np.arange(len(a)), len(rows)
    keep = np.zeros(len(a), bool)
    row, at = np.concatenate([a, b]), np.concatenate([rank, rank])
    by_row = np.lexsort((at, row))
    first = np.flatnonzero(np.append(True, row[by_row][1:] != row[by_row][:-1]))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep[at[by_row[place < NEAREST]]] = True
    label, live = np.arange(n), rank
    while True:  # each group takes its least link to another
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        has = np.flatnonzero(best < len(a))
        link = best[has]
        keep[link] = True
        to = np.arange(n)
        to[has] = np.where(label[a[link]] == has, label[b[link]], label[a[link]])
        both = has[(to[to[has]] == has) & (has < to[has])]
        to[both] = both
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        label = to[label]
    out = np.zeros(len(order), bool)
    out[order] = keep
    return out


def _tree(x: np.ndarray, by_shingle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest by the least distances over the rows of one very large key, without holding its pairs."""
    rest, far, of = np.arange(len(x)), np.full(len(x), 1 << 20), np.full(len(x), -1)
    links = []
    while len(rest):
        i = int(far[rest].argmin())
        new, rest = int(rest[i]), np.delete(rest, i)
        if of[new] >= 0:
            links.append((int(of[new]), new, int(far[new])))
        ok, d = _chains(x[rest] ^ x[new], np.bool_(by_shingle))
        nearer = rest[ok & (d < far[rest])]
        far[nearer], of[nearer] = d[ok & (d < far[rest])], new
    got = np.array(links, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


def _pairs(key: np.ndarray, x: np.ndarray):
    """(a, b, d): links among rows that are sorted by key, in parts; of whole keys."""
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    by_shingle = key >> np.uint64(32) == np.uint64(_BY_SHINGLE)
    ends, small = np.repeat(new + size, size), np.repeat(size <= SHIFTS, size)
    for low in range(0, len(key), CHUNK):  # a link lies where its first row does; a key may span two parts
        first = int(new[np.searchsorted(new, low, "left")]) if low <= new[-1] else len(key)
        high = int(new[np.searchsorted(new, low + CHUNK, "left")]) if low + CHUNK <= new[-1] else len(key)
        a, found = first + np.flatnonzero(small[first:high]), []
        for shift in range(1, SHIFTS):
            a = a[a + shift < ends[a]]
            if not len(a):
                break
            ok, d = _chains(x[a] ^ x[a + shift], by_shingle[a])
            found.append((a[ok], a[ok] + shift, d[ok]))
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found))
    for g in np.flatnonzero(size > SHIFTS):
        low, n = int(new[g]), int(size[g])
        if n > HELD:
            a, b, d = _tree(x[low : low + n], bool(by_shingle[low]))
        else:
            parts = []
            for i in range(0, n, max(1, CHUNK // n)):
                rows = np.arange(i, min(n, i + max(1, CHUNK // n)))
                ok, far = _chains(x[low + rows][:, None] ^ x[low : low + n][None, :], np.bool_(by_shingle[low]))
                a, b = np.nonzero(ok & (np.arange(n)[None, :] > rows[:, None]))
                parts.append((rows[a], b, far[a, b]))
            a, b, d = (np.concatenate(c) for c in zip(*parts))
        yield low + a, low + b, d


def candidates(classes: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """u, v, n and d of candidate pairs of ids: met under n keys, the least differing bits after one. classes: id, f, head."""
    spark = classes.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * RINGS * SEGMENTS // BUCKET_KEYS))

    def pack(ids, prints, heads) -> pa.RecordBatch:
        f = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, BITS // 8)
        ids = np.array(ids, np.int64)
        key, after = ring_keys(f)
        sizes = [len(h) // 8 for h in heads]
        shingle = np.frombuffer(b"".join(heads), np.uint64) & np.uint64(0xFFFFFFFF) | np.uint64(_BY_SHINGLE << 32)
        key = np.concatenate([key.ravel(), shingle])
        x = np.concatenate([after.reshape(-1, 2), np.repeat(after[:, 0], sizes, axis=0)])
        of = np.concatenate([np.repeat(ids, RINGS * SEGMENTS), np.repeat(ids, sizes)])
        with np.errstate(over="ignore"):
            bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, x, of, bucket = key[order], x[order], of[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = [zstandard.compress(np.diff(key[i:j], prepend=np.uint64(0)).tobytes() + of[i:j].tobytes() + x[i:j].T.tobytes(), 1) for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def send(batches):
        held("copies")
        rows: list = [[], [], []]
        for b in batches:
            for i in range(3):
                rows[i] += b.column(i).to_pylist()
            if len(rows[0]) >= FLUSH:
                yield pack(*rows)
                rows = [[], [], []]
        if rows[0]:
            yield pack(*rows)

    def meet(batches):
        held("copies")
        parts = []
        for b in batches:
            for blob in b.column(1).to_pylist():
                a = np.frombuffer(zstandard.decompress(blob), np.uint64).reshape(4, -1)
                parts.append((np.cumsum(a[0], dtype=np.uint64), a[1].view(np.int64), a[2:].T))
        if not parts:
            return
        key, of, x = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(key, kind="stable")
        key, of, x = key[order], of[order], x[order]
        same = key[1:] == key[:-1]
        meets = np.append(same, False) | np.append(False, same)
        key, of, x = key[meets], of[meets], x[meets]
        if not len(key):
            return
        for a, b, d in _pairs(key, x):
            keep = _sparse(a, b, d)
            u, v = of[a[keep]], of[b[keep]]
            far = u != v  # a set may hold two shingles under one key
            u, v, d = u[far], v[far], d[keep][far]
            for low in range(0, len(u), 100_000):
                part = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)[part]), pa.array(np.maximum(u, v)[part]), pa.array(d[part].astype(np.int32))], names=["u", "v", "d"])

    blobs = classes.select("id", "f", "head").mapInArrow(tidy(send), BLOB)
    met = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(meet), EDGE)
    return cut(met.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("d").alias("d")))


def _compare(pairs: DataFrame, wholes: DataFrame, least: tuple[int, int], bounded: bool = True) -> DataFrame:
    """The pairs (u, v), of those within the budget where it is bounded, whose sets have the index. wholes: id, f, whole."""
    p, q = least

    def verify(batches):
        one, mark = np.empty(0, np.uint64), np.empty(0, np.uint8)
        for b in batches:
            keep = []
            for v, f, whole in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                f, whole = np.frombuffer(f, np.uint8), np.frombuffer(whole, np.uint64)
                if v is None:  # u's own set, before its pairs
                    one, mark = whole, f
                    keep.append(False)
                    continue
                few = not bounded or len(whole) < FEW or len(one) < FEW
                if not few and int(np.bitwise_count(mark ^ f).sum(dtype=np.int64)) > MOST:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(one, whole, assume_unique=True))
                keep.append((p + q) * both >= p * (len(one) + len(whole)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select("u").distinct()
    firsts = wholes.join(asked, wholes["id"] == asked["u"], "left_semi").select(F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), "f", "whole")
    sides = firsts.unionByName(pairs.select("u", "v").join(wholes.withColumnRenamed("id", "v"), "v").select("u", "v", "f", "whole"))
    return cut(sides.repartition("u").sortWithinPartitions("u", F.col("v").asc_nulls_first()).mapInArrow(tidy(verify), "u long, v long"))


def _within(pairs: DataFrame, wholes: DataFrame) -> DataFrame:
    """The pairs within the budget of all bits, or of which a set has few shingles."""

    def check(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BITS // 8) for i in (2, 3))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            few = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(few | (far <= MOST)))

    marks = wholes.select("id", "f", (F.octet_length("whole") < 8 * FEW).alias("few"))
    one = marks.select(F.col("id").alias("u"), F.col("f").alias("x"), F.col("few").alias("few1"))
    two = marks.select(F.col("id").alias("v"), F.col("f").alias("y"), F.col("few").alias("few2"))
    return cut(pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y", (F.col("few1") | F.col("few2")).alias("few")).mapInArrow(tidy(check), "u long, v long"))


def _between(edges: DataFrame, groups: DataFrame, tested: DataFrame) -> DataFrame:
    """u, v of edges between different groups that haven't been compared. groups: u -> v, its least."""
    of = groups.withColumnsRenamed({"u": "member", "v": "least"})
    left = edges.join(of, edges["u"] == of["member"], "left").select("u", "v", F.coalesce("least", "u").alias("x"))
    both = left.join(of, left["v"] == of["member"], "left").select("u", "v", "x", F.coalesce("least", "v").alias("y"))
    return both.filter("x != y").join(tested, ["u", "v"], "left_anti").select("u", "v")


def _best(edges: DataFrame) -> DataFrame:
    """For each end, of each part of its edges, the one that met most often, and of those the one with the least distance."""
    pair, order = F.struct("u", "v"), F.struct(-F.col("n"), "d", "u", "v")
    part = F.pmod(F.xxhash64("u", "v"), F.lit(CHOICES))
    ends = [edges.select(F.col(end).alias("of"), part.alias("part"), pair.alias("pair"), order.alias("o")) for end in "uv"]
    return cut(ends[0].unionByName(ends[1]).groupBy("of", "part").agg(F.min_by("pair", "o").alias("pair")).select("pair.u", "pair.v").distinct())


def _wholes(rows: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """id, f, whole: the shingle sets of all ids in pairs (u, v), from the texts (rows: k, t)."""
    asked = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    asked = cut(classes.join(asked, "id").select("id", "c", "rep"))
    wanted = filter_of(asked.select(F.xxhash64("rep").alias("h")))
    some = rows.filter(passing(wanted)(F.xxhash64("k"))) if wanted is not None else rows

    def whole(batches):
        held("copies")
        for b in batches:
            found = [shingles(t, words) for t in strings(b.column(0))]
            yield pa.RecordBatch.from_arrays([_names(found), pa.array([r.tobytes() for r in wide(found)], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "f", "whole"])

    wholes = some.select("t").mapInArrow(tidy(whole), "c long, f binary, whole binary").join(asked.select("id", "c"), "c")
    return cut(wholes.groupBy("id").agg(F.first("f").alias("f"), F.first("whole").alias("whole")))


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _frequent(found: DataFrame):
    """A broadcast of the most frequent shingles, ascending, and how often they stand (as their counts at a time tell)."""

    def read(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                a = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1])], names=["s", "n"])

    told = found.filter("often IS NOT NULL").select("often").mapInArrow(tidy(read), "s long, n long")
    top = told.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()  # 16 bytes each
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return found.sparkSession.sparkContext.broadcast((s[order], n[order]))


def first_shingles(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """The shingles by one of which a set meets every other with the index, the rarest first."""
    p, q = least
    known, times = frequent
    n = np.zeros(len(s), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        n = np.where(known[at] == s, times[at], 0)
    return s[np.lexsort((s, n))[: len(s) - -(-len(s) * p // q) + 1]]


def key_bytes(s: np.ndarray) -> bytes:
    """The first KEY_BYTES of each shingle."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def squeeze(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Keys (rows of KEY_BYTES) and columns of integers that change little from row to row, compressed byte by byte."""
    steps = np.stack([np.diff(c, prepend=0) for c in columns])
    zigzag = (steps << 1 ^ steps >> 63).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(keys.T).tobytes() + np.ascontiguousarray(zigzag).tobytes(), 1)


def unsqueeze(data: bytes, columns: int) -> np.ndarray:
    """Rows of integers: the keys, then the columns."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // (KEY_BYTES + 8 * columns)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, 8 - KEY_BYTES :] = raw[: n * KEY_BYTES].reshape(KEY_BYTES, n).T
    zigzag = np.ascontiguousarray(raw[n * KEY_BYTES :].reshape(8, -1).T).view(np.int64).reshape(columns, n)
    steps = (zigzag.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(zigzag & 1)
    return np.concatenate([keys.view(">i8").reshape(1, n).astype(np.int64), np.cumsum(steps, axis=1)])


def _met(key: np.ndarray, ids: np.ndarray, label: np.ndarray, size: np.ndarray, place: np.ndarray, least: tuple[int, int]):
    """Rows u, v, n, short, fits in parts: of pairs of one key and different labels that sizes and places allow, how many keys they met under (n).

    Sets with the index have at least `short` first shingles in common: in the order of all
    shingles, what two sets have in common beyond these lies behind the first shingles of one of
    them. fits: whether a key may be the least they have in common. Rows by key.
    """
    p, q = least
    ends = np.searchsorted(key, key, "right")
    low = 0
    while low < len(key):
        pairs = np.cumsum(ends[low:] - np.arange(low, len(key)) - 1)
        high = low + max(1, int(np.searchsorted(pairs, CHUNK * 20, "right")))
        each = ends[low:high] - np.arange(low, high) - 1
        a = np.repeat(np.arange(low, high), each)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        need = -(-p * (size[a] + size[b]) // (p + q))  # what two sets of the index have in common
        most = np.minimum(size[a] - place[a], size[b] - place[b])  # of it, from this key on
        may = most + np.minimum(place[a], place[b]) >= need
        a, b, need, most = a[may], b[may], need[may], most[may]
        if len(a):
            rest = -(-np.maximum(size[a], size[b]) * p // q) - 1  # behind the first shingles
            rows = np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), need - rest, most >= need])
            rows = rows[:, np.lexsort(rows[1::-1])]
            new = np.flatnonzero(np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))
            yield np.stack([*rows[:2, new], np.diff(np.append(new, rows.shape[1])), rows[2, new], np.maximum.reduceat(rows[3], new)])
        low = high


def _missed(rows: DataFrame, classes: DataFrame, groups: DataFrame, frequent, words: int, least: tuple[int, int]) -> DataFrame:
    """u, v: all pairs that may have the index and aren't in one group. groups: u -> v, its least."""
    spark = rows.sparkSession

    def prefixes(batches):
        held("copies")
        for b in batches:
            found = [s for s in (shingles(t, words) for t in strings(b.column(0))) if len(s)]
            firsts = [key_bytes(first_shingles(s, frequent.value, least)) for s in found]
            yield pa.RecordBatch.from_arrays([_names(found), pa.array([len(s) for s in found], pa.int64()), pa.array(firsts, pa.binary())], names=["c", "n", "firsts"])

    own = rows.select("t").mapInArrow(tidy(prefixes), "c long, n long, firsts binary").groupBy("c").agg(F.first("n").alias("n"), F.first("firsts").alias("firsts"))
    labelled = classes.select("id", "c").join(groups.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left")
    own = own.join(labelled, "c").select("id", F.coalesce("label", "id").alias("label"), "n", "firsts")
    total = classes.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_KEYS))

    def pack(parts) -> pa.RecordBatch:
        ids, label, n = (np.array(c, np.int64) for c in parts[:3])
        each = np.array([len(f) // KEY_BYTES for f in parts[3]], np.int64)
        keys = np.frombuffer(b"".join(parts[3]), np.uint8).reshape(-1, KEY_BYTES)
        of = np.repeat(np.arange(len(ids)), each)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(each) - each, each)
        key = np.zeros((len(keys), 8), np.uint8)
        key[:, :KEY_BYTES] = keys
        with np.errstate(over="ignore"):
            bucket = (key.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        keys, of, place, bucket = keys[order], of[order], place[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            o = of[i:j]
            blobs.append(squeeze(keys[i:j], [ids[o], label[o] - ids[o], n[o], place[i:j]]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def send(batches):
        held("copies")
        parts: list = [[], [], [], []]
        size = 0
        for b in batches:
            for i in range(4):
                parts[i] += b.column(i).to_pylist()
            size += sum(map(len, parts[3][-b.num_rows :])) if b.num_rows else 0
            if size >= BUCKET_KEYS * KEY_BYTES:
                yield pack(parts)
                parts, size = [[], [], [], []], 0
        if parts[0]:
            yield pack(parts)

    def meet(batches):
        held("copies")
        parts = [np.empty((5, 0), np.int64)]
        for b in batches:
            parts += [unsqueeze(d, 4) for d in b.column(1).to_pylist()]
        a = np.concatenate(parts, axis=1)
        del parts
        a = a[:, np.argsort(a[0], kind="stable")]
        same = a[0, 1:] == a[0, :-1]
        a = a[:, np.append(same, False) | np.append(False, same)] if a.shape[1] else a
        for met in _met(a[0], a[1], a[1] + a[2], a[3], a[4], least):
            for low in range(0, met.shape[1], 100_000):
                part = met[:, low : low + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.copy()) for c in part[:2]), *(pa.array(c.astype(np.int32)) for c in part[2:])], names=["u", "v", "n", "short", "fits"])

    blobs = own.select("id", "label", "n", "firsts").mapInArrow(tidy(send), BLOB)
    met = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(meet), "u long, v long, n int, short int, fits int")
    met = met.groupBy("u", "v").agg(F.sum("n").alias("n"), F.max("short").alias("short"), F.max("fits").alias("fits"))
    return cut(met.filter("fits = 1 AND n >= short").select("u", "v"))


def near(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """Key and component_id of each row with words: the least key that can be reached over near copies.

    Only pairs of the Jaccard index p/q or more link, by comparison of whole shingle sets, and
    every such pair is in one component. Equal sets are one class, of any number of rows. Rows
    without words, empty or null, are near no other and give no row. A null key gets a row and
    its component's least key (null if all are). Repeated rows give a row each; other columns
    are not carried; an empty table gives no rows. Shingles and sets are known by 64 bits of
    hash. Texts of any length are compared whole.
    """
    bounded_batches(df.sparkSession)
    p, q = least
    rows = df.select(column(key).alias("k"), column(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def counts(seen: list, arrow_kind: pa.DataType) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(seen), return_counts=True)
        often = times >= OFTEN
        data = found[often].tobytes() + times[often].astype(np.uint64).tobytes()
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(1, arrow_kind), *nothing, pa.array([data], pa.binary())], names=["k", "c", "n", "f", "head", "often"])

    def sets(batches):
        held("copies")
        seen, size = [], 0
        for b in batches:
            found = [shingles(t, words) for t in strings(b.column(1))]
            some = [i for i, s in enumerate(found) if len(s)]
            found = [found[i] for i in some]
            heads = [s[: len(s) - -(-len(s) * p // q) + 1].tobytes() if len(s) * p < FEW * q else b"" for s in found]
            prints = [r.tobytes() for r in wide(found)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), _names(found), pa.array([len(s) for s in found], pa.int64()), pa.array(prints, pa.binary()), pa.array(heads, pa.binary()), pa.nulls(len(some), pa.binary())], names=["k", "c", "n", "f", "head", "often"])
            seen += found
            size += sum(map(len, found))
            if size >= COUNTED:
                yield counts(seen, b.column(0).type)
                seen, size = [], 0
        if size:
            yield counts(seen, b.column(0).type)

    both = cut(rows.mapInArrow(tidy(sets), f"k {kind}, c long, n long, f binary, head binary, often binary"))
    own = both.filter("c IS NOT NULL").drop("often")
    classes = own.groupBy("c").agg(F.min("k").alias("rep"), F.first("n").alias("n"), F.first("f").alias("f"), F.first("head").alias("head"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    edges = candidates(classes, words, least)
    let_go(df.sparkSession)
    wholes = _wholes(rows, classes, edges, words)
    let_go(df.sparkSession)
    tested = _best(edges)
    links = _compare(tested, wholes, least)
    let_go(df.sparkSession)
    left = cut(_between(edges, components(links), tested))
    links = cut(links.union(_compare(_within(left, wholes), wholes, least)))
    let_go(df.sparkSession)
    missed = _missed(rows, classes, components(links), _frequent(both), words, least)
    let_go(df.sparkSession)
    if not missed.isEmpty():
        links = links.union(_compare(missed, _wholes(rows, classes, missed, words), least, bounded=False))
    let_go(df.sparkSession)
    least_of = components(links)
    labelled = cut(classes.select(F.col("id").alias("u"), "c", "rep").join(least_of, "u", "left").select("c", "rep", F.coalesce("v", "u").alias("label")))
    of = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    found = labelled.join(of, "label").select("c", "component_id")
    return own.select("k", "c").join(found, "c").select(F.col("k").alias(key), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of df, all columns as they are, whatever their names, with one row of each group of near copies.

    The row with the least key stays. Rows without words (empty or null texts) or with a null
    key stay all. Of rows that repeat key and text one stays; a key that stays for one text stays
    for its others. An empty table gives no rows. Texts of any length are compared whole.
    """
    from sluice.llm.common import WORD

    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    rows = df.toDF(*names.values())
    k, t = names[key], names[text]
    wordy = F.coalesce(F.col(t).rlike(WORD), F.lit(False))
    found = cut(near(rows.filter(F.col(k).isNotNull() & wordy), k, t, words, least).select(F.col(k).alias("__k"), "component_id"))
    gone = cut(found.groupBy("__k").agg(F.max(F.col("__k") == F.col("component_id")).alias("stays"), F.count("*").alias("n")))
    kept = rows.join(gone.filter("NOT stays").select("__k"), (F.col(k) == F.col("__k")) & wordy, "left_anti")
    if not gone.filter("n > 1").isEmpty():
        null = kept.filter(F.col(k).isNull())
        kept = kept.filter(F.col(k).isNotNull()).dropDuplicates([k, t]).unionByName(null)
    return kept.toDF(*df.columns)
