"""SimHash near-dedup with pigeonring filtering.

A fingerprint of 64 bits (or of several such lanes) holds, for each bit, whether it is set in
over half of the hashes of a text's word shingles. Fingerprints within `most` differing bits
are linked. Its bits lie on a ring of most + 1 segments. By the pigeonring principle two
linked fingerprints have a segment from which every chain of consecutive segments stays
within its proportional budget: l segments differ in l * most / (most + 1) bits at most,
rounded down l - 1. So the chain's first segment is equal and its first two differ in one
bit at most; those two make the key under which candidates meet: each fingerprint is sent
once with its own key and once with each set bit of the second segment cleared. Longer chains
are then checked before the full distance is.

Equal fingerprints are one class, linked once. In a bucket with a dense cluster only as many
links are returned as connect what the bucket connects, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, cut, held, strings, tidy
from sluice.llm.graph import components

SEED = 42

#: Rows of a bucket up to which its pairs are compared by shifts of the whole batch.
SMALL = 24

#: Pairs compared at a time.
BLOCK = 1 << 18


def hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; the whole sequence where there are fewer words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: len(w) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(w) - words + 1)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes for a further lane: the first lane's, mixed anew."""
    if not lane:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30)) ^ np.uint64(lane)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, words: int = 4, lanes: int = 1) -> list[int]:
    """The lanes as signed 64-bit integers; zero for a text without words."""
    h = hashes(text, words)
    if not len(h):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        bits = np.unpackbits(_lane(h, lane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """Key and lanes f0, f1, ... of each row's whole text; null counts as empty, whose lanes are zero."""
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = [f"f{i}" for i in range(lanes)]

    def run(batches):
        held("simhash")
        for b in batches:
            got = np.array([fingerprint(t, words, lanes) for t in strings(b.column(1))], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i]) for i in range(lanes))], names=[key, *names])

    return df.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))


class Ring:
    """Segments of the fingerprint's bits on a ring, and the masks of their chains."""

    def __init__(self, most: int, lanes: int):
        self.most, self.lanes, self.segments = most, lanes, most + 1
        bits = 64 * lanes
        edges = [bits * i // self.segments for i in range(self.segments + 1)]
        self.at = list(zip(edges, edges[1:]))
        #: chains[l - 1][start]: mask (a word for each lane) of the l segments from start
        self.chains = np.zeros((self.segments, self.segments, lanes), np.uint64)
        for start in range(self.segments):
            mask = [0] * lanes
            for length in range(self.segments):
                low, high = self.at[(start + length) % self.segments]
                for bit in range(low, high):
                    mask[bit // 64] |= 1 << bit % 64
                self.chains[length, start] = mask

    def part(self, f: np.ndarray, segment: int) -> np.ndarray:
        """A segment's value for each row of f (rows x lanes)."""
        low, high = self.at[segment]
        lane, shift = low // 64, low % 64
        v = f[:, lane] >> np.uint64(shift)
        if high > 64 * (lane + 1):
            v = v | f[:, lane + 1] << np.uint64(64 - shift)
        return v & np.uint64((1 << high - low) - 1)

    def keys(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, own): own 0 for a row's own key, 1 for one with a bit cleared."""
        rows, keys, own = [], [], []
        every = np.arange(len(f))
        for start in range(self.segments):
            after = (start + 1) % self.segments
            width = self.at[after][1] - self.at[after][0]
            first, second = self.part(f, start), self.part(f, after)
            head = (np.uint64(start) << np.uint64(56)) | first << np.uint64(width)
            rows.append(every)
            keys.append(head | second)
            own.append(np.zeros(len(f), np.int8))
            for bit in range(width):
                has = np.flatnonzero(second >> np.uint64(bit) & np.uint64(1))
                rows.append(has)
                keys.append(head[has] | second[has] ^ np.uint64(1 << bit))
                own.append(np.ones(len(has), np.int8))
        return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(own)

    def linked(self, x: np.ndarray, start) -> np.ndarray:
        """Which differences x (pairs x lanes) of candidates from a start (one, or one for each pair) are links."""
        live = np.arange(len(x))
        for length in range(2, self.segments):
            mask = self.chains[length][start if np.isscalar(start) else start[live]]
            live = live[np.bitwise_count(x[live] & mask).sum(axis=-1) <= length]
            if not len(live):
                break
        return live  # the last chain is the whole ring: the full distance


def _forest(n: int, rows) -> list[tuple[int, int]]:
    """As few of the links (i, array of j) as connect the same."""
    label = np.arange(n)
    out = []
    for i, js in rows:
        js = js[label[js] != label[i]]
        if len(js):
            other, first = np.unique(label[js], return_index=True)
            out += [(i, int(js[k])) for k in first]
            label[np.isin(label, other)] = label[i]
    return out


def _bucket(ring: Ring, f: np.ndarray, own: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large bucket; own rows are compared with all later ones."""
    mine = int((own == 0).sum())  # they come first
    step = max(1, BLOCK // len(f))
    found = []

    def rows():
        for low in range(0, mine, step):
            high = min(low + step, mine)
            a, b = np.divmod(np.arange((high - low) * len(f)), len(f))
            a += low
            keep = b > a
            a, b = a[keep], b[keep]
            hit = ring.linked(f[a] ^ f[b], start)
            a, b = a[hit], b[hit]
            for i in np.unique(a):
                yield int(i), b[a == i]

    found = _forest(len(f), rows())
    got = np.array(found, np.int64).reshape(-1, 2)
    return f[got[:, 0]], f[got[:, 1]]


def _links(ring: Ring, key: np.ndarray, own: np.ndarray, f: np.ndarray):
    """Links among rows sorted by key and own, of whole buckets: two arrays of fingerprints."""
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, len(key)))
    start = (key.view(np.uint64) >> np.uint64(56)).astype(np.int64)
    us, vs = [np.empty((0, ring.lanes), np.uint64)], [np.empty((0, ring.lanes), np.uint64)]
    has_own = own[new] == 0
    large = np.repeat((size > SMALL), size)
    use = np.repeat(has_own & (size > 1), size) & ~large
    a = np.flatnonzero(use & (own == 0))
    ends = np.repeat(new + size, size)
    for shift in range(1, SMALL):
        a = a[a + shift < ends[a]]
        if not len(a):
            break
        for low in range(0, len(a), BLOCK):
            x = a[low : low + BLOCK]
            hit = x[ring.linked(f[x] ^ f[x + shift], start[x])]
            us.append(f[hit])
            vs.append(f[hit + shift])
    for g in np.flatnonzero(has_own & (size > SMALL)):
        low, high = new[g], new[g] + size[g]
        u, v = _bucket(ring, f[low:high], own[low:high], int(start[low]))
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def links(classes: DataFrame, most: int, lanes: int = 1) -> DataFrame:
    """u and v (structs of lanes): links that connect all fingerprints within `most` differing bits.

    classes: distinct lanes f0, f1, ... Every link's ends are connected by the rows returned.
    A bucket's size is bounded by the number of different fingerprints near one key, not by
    the number of documents; rows of a bucket are compared in blocks.
    """
    bounded_batches(classes.sparkSession)
    names = [f"f{i}" for i in range(lanes)]
    ring = Ring(most, lanes)
    kind = ", ".join(f"{n} long" for n in names)

    def send(batches):
        for b in batches:
            f = np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(lanes)], axis=1)
            row, key, own = ring.keys(f)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), *(pa.array(f[row, i].view(np.int64)) for i in range(lanes))], names=["key", "own", *names])

    def meet(batches):
        rows: list = []
        sent = [f"u{i}" for i in range(lanes)] + [f"v{i}" for i in range(lanes)]

        def out(cols):
            f = np.stack([c.view(np.uint64) for c in cols[2:]], axis=1)
            u, v = _links(ring, cols[0], cols[1], f)
            both = np.unique(np.concatenate([u, v], axis=1), axis=0) if len(u) else np.empty((0, 2 * lanes), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, i].view(np.int64)) if len(both) else pa.array([], pa.int64()) for i in range(2 * lanes)], names=sent)

        for b in batches:
            rows.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(2 + lanes)])
            if sum(len(h[0]) for h in rows) < 200_000:
                continue
            cols = [np.ascontiguousarray(np.concatenate(c)) for c in zip(*rows)]
            cutoff = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last bucket may go on
            rows = [[c[cutoff:] for c in cols]]
            if cutoff:
                yield out([c[:cutoff] for c in cols])
        if rows:
            yield out([np.ascontiguousarray(np.concatenate(c)) for c in zip(*rows)])

    sides = classes.select(*names).mapInArrow(tidy(send), f"key long, own byte, {kind}")
    sides = sides.repartition("key").sortWithinPartitions("key", "own")
    got = sides.mapInArrow(tidy(meet), ", ".join(f"{e}{i} long" for e in "uv" for i in range(lanes)))
    return got.select(F.struct(*[F.col(f"u{i}").alias(f"f{i}") for i in range(lanes)]).alias("u"), F.struct(*[F.col(f"v{i}").alias(f"f{i}") for i in range(lanes)]).alias("v"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1, most: int = 4) -> DataFrame:
    """Key, lanes and component_id of each row: the least key that can be reached over links.

    Empty and null texts have fingerprint zero and are linked like any other. A null key gets
    a row and its component's least key (null if all are). Repeated rows give a row each.
    """
    names = [f"f{i}" for i in range(lanes)]
    own = cut(fingerprints(df, key, text, words, lanes))
    classes = cut(own.groupBy(*names).agg(F.min(key).alias("rep")))
    least = components(links(classes, most, lanes))
    me = F.struct(*[F.col(n) for n in names])
    labelled = classes.withColumn("u", me).join(least, "u", "left").select(*names, "rep", F.coalesce("v", "u").alias("label"))
    labelled = cut(labelled)
    # cut, so that the join below stands alone and Spark can split a large component
    of = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    found = labelled.join(of, "label").select(*names, "component_id")
    return own.join(found, names).select(key, *names, "component_id")
