import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import copies, graph, queries, simhash
from tests_llm_helpers import find_components


def brute_fingerprint(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r.text or "", 4)[0] % 2**64 == brute_fingerprint(r.text, 4)


@pytest.mark.parametrize("most, lanes", [(4, 1), (3, 1), (20, 2), (7, 1)])
def test_every_link_is_connected(spark, most, lanes):
    """Clusters of all densities, some large, against all pairs."""
    rng = np.random.default_rng(most)
    f = [rng.integers(-(1 << 63), 1 << 63, lanes) for _ in range(300)]
    for size, flips in ((400, 3), (60, most), (60, most // 2), (30, most + 2)):
        centre = rng.integers(-(1 << 63), 1 << 63, lanes)
        for _ in range(size):
            x = centre.copy()
            for b in rng.integers(0, 64 * lanes, rng.integers(0, flips + 1)):
                x[b // 64] ^= np.int64(np.uint64(1 << int(b % 64)).view(np.int64))
            f.append(x)
    f = np.unique(np.array(f), axis=0)
    u = f.view(np.uint64)
    pairs = [(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]).sum(axis=1) <= most) + i + 1]
    want = find_components(range(len(f)), pairs)
    names = [f"f{i}" for i in range(lanes)]
    df = spark.createDataFrame([tuple(map(int, x)) for x in f], ", ".join(f"{n} long" for n in names))
    number = {tuple(map(int, x)): i for i, x in enumerate(f)}
    got = [(number[tuple(r.u)], number[tuple(r.v)]) for r in simhash.links(df, most, lanes).collect()]
    assert all(np.bitwise_count(u[i] ^ u[j]).sum() <= most for i, j in got)
    assert find_components(range(len(f)), got) == want
    assert len(got) < len(pairs)  # a dense cluster isn't sent pair by pair


def test_groups(docs, none):
    rows = docs.collect()
    fps = sorted({brute_fingerprint(r.text, 4) for r in rows})
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    label = find_components(fps, pairs)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = label[brute_fingerprint(r.text, 4)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), brute_fingerprint(r.text, 4), repr(least.get(label[brute_fingerprint(r.text, 4)]))) for r in rows)
    got = sorted((repr(r.doc_id), r.f0 % 2**64, repr(r.component_id)) for r in simhash.groups(docs).collect())
    assert got == want
    assert simhash.groups(none).count() == 0


def test_keep_one(docs, none):
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(0) == 1 and 1 not in ids and 2 not in ids and 11 not in ids  # copies and near copies of 0
    assert ids.count(3) == 1  # repeated rows
    assert 15 in ids and 16 not in ids
    assert ids.count(None) == 2 and {4, 5, 6, 7, 8, 9, 10} <= set(ids)
    assert copies.keep_one(none).count() == 0


def test_near_copies_against_all_pairs(spark):
    """Pairs just over, at and just under the index 0.8, chains of them, and a shingle that most texts share."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(150):
        base = rng.choice(vocabulary, int(rng.integers(3, 120))).tolist()
        if i % 2:
            base = ["one", "line", "that", "many", "texts", "have"] + base
        texts.append(base)
        for _ in range(3):
            x = list(texts[-1] if i % 3 else base)
            for _ in range(int(rng.integers(0, 4))):
                x[int(rng.integers(0, len(x)))] = str(rng.choice(vocabulary))
            cut = int(rng.integers(0, 1 + len(x) // 6))
            texts.append(x[cut:] or x)
    # 40 and 32 shingles of which 32 are shared: exactly 0.8; one less: under it
    line = [f"e{i}" for i in range(44)]
    texts += [line, line[:36], [f"x{i}" for i in range(44)], [f"x{i}" for i in range(35)]]
    texts = [" ".join(x) for x in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = find_components(range(len(texts)), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in copies.near(df).collect()} == want
    assert sorted(r.doc_id for r in copies.keep_one(df).collect()) == sorted(set(want.values()))
    n = len(texts)
    assert want[n - 3] == want[n - 4] and want[n - 1] != want[n - 2]


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(1900, 2300)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r.u: r.v for r in graph.components(df).collect()}
    want = find_components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}
    assert graph.components(df.filter(F.lit(False))).count() == 0
    two = df.select(F.struct(F.col("u").alias("a"), F.lit(1).alias("b")).alias("u"), F.struct(F.col("v").alias("a"), F.lit(1).alias("b")).alias("v"))
    assert {r.u.a: r.v.a for r in graph.components(two).collect()} == got


def test_settled_is_exact(spark, monkeypatch):
    """Tables that agree in count and sum aren't taken for equal."""
    monkeypatch.setattr(graph, "_sum", lambda df: (df.count(), 0))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    pairs = [(i, i + 1) for i in range(300)]
    got = {r.u: r.v for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)}


def test_large_groups_of_near_copies(spark):
    """A group of copies with other words changed in each, many of them at the edge of the index: no wrong link, nearly all found."""
    rng = np.random.default_rng(5)
    base = rng.choice([f"w{i}" for i in range(3000)], 300).tolist()
    texts = []
    for _ in range(400):
        x = list(base)
        for i in rng.integers(0, 300, int(rng.integers(1, 9))):
            x[int(i)] = f"new{rng.integers(0, 10000)}"
        texts.append(" ".join(x))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    pairs = [(i, j) for i in range(400) for j in range(i + 1, 400) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = find_components(range(400), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in copies.near(df).collect()}
    assert all(want[i] == want[j] for i, j in got.items())
    together = sum(got[i] == got[j] for i in range(400) for j in range(i) if want[i] == want[j])
    assert together >= 0.98 * sum(want[i] == want[j] for i in range(400) for j in range(i))


def test_sparse_links_connect_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (2, 3, 40, 200):
        x = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        x[: n // 2] = x[0] ^ (np.uint64(1) << rng.integers(0, 64, (n // 2, 2), dtype=np.uint64))
        key = np.zeros(n, np.uint64)
        ok = np.array([[bool(copies._chains(a ^ b, np.bool_(False))[0]) for b in x] for a in x])
        want = find_components(range(n), list(zip(*np.nonzero(ok))))
        for held in (copies.HELD, 0):
            monkeypatch.setattr(copies, "HELD", held)
            found = []
            for a, b, d in copies._pairs(key, x):
                keep = copies._sparse(a, b, d)
                assert keep.sum() <= (copies.NEAREST + 1) * n
                found += zip(a[keep].tolist(), b[keep].tolist())
            assert find_components(range(n), found) == want


def test_keep_one_leaves_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y")], "`doc_id` long, `text` string, `__k` string")
    df = df.withColumns({"component_id": F.lit(7), "id": F.lit("i"), "u": F.lit("u")}).withColumnRenamed("u", "a.b")
    got = copies.keep_one(df)
    assert got.columns == df.columns
    assert got.collect() == [df.collect()[0]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    """The registered columns against brute force over all pairs."""
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: brute_fingerprint(r.text, 4) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pairs = [(a, b) for a in rows for b in rows if a < b and (rows[a] ^ rows[b]).bit_count() <= 4]
    label = find_components(rows, pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", label[i]) for i, f in rows.items()}
