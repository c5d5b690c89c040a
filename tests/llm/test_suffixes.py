import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import prose, rows
from sluice.llm import suffixes


def brute(texts):
    """(doc, bytes) in corpus order -> kept bytes and runs of each."""
    seen, out = set(), []
    for data in texts:
        mark = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        runs, i = [], 0
        while i < len(data):
            if mark[i]:
                j = i
                while j < len(data) and mark[j]:
                    j += 1
                runs.append((i, j))
                i = j
            i += 1
        out.append((bytes(b for b, m in zip(data, mark) if not m), runs))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (bytes(r["__kept"]), [(s.start, s.end) for s in r["__spans"]]) for r in suffixes.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_passages(spark):
    r = random.Random(2)
    lines = [prose(100 + i, 30) for i in range(4)]
    texts = [prose(i, r.randint(5, 80)) + r.choice(lines) + prose(1000 + i, r.randint(5, 60)) + r.choice(lines)[: r.randint(80, 140)] for i in range(60)]
    check(spark, texts + texts[:3] + [texts[5][7:], "é" + texts[6], ""])


def test_periodic(spark):
    check(spark, ["a" * 500, "ab" * 200, "a" * 99, "a" * 100, "Ouor " * 60, "xyz" * 40 + "a" * 130, "é" * 90])


def test_common_line_in_many_contexts(spark):
    """More different phrases of a trigger than are gathered: the windows meet by hash."""
    line = prose(77, 40)
    texts = [prose(i, 12) + line + prose(5000 + i, 12) for i in range(suffixes.LOCAL_PHRASES * 2)]
    check(spark, texts)


def test_edges(spark, docs, none):
    got = suffixes.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    data = [r for r in rows()]
    ids = {}
    for r in data[:17]:
        ids[r[0]] = (r[1] or "").encode()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(bytes(r["__kept"]))
    assert found[0] == {ids[0]} and found[1] == {b""}  # a copy goes
    assert len(found[3]) == 1 and found[3] == {ids[3]}  # repeated rows are judged alike
    assert len(found[4]) == 2 and found[5] == {b""}
    assert suffixes.remove_repeats(none).count() == 0
    kept = suffixes.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert sum(r.text is None for r in kept.collect()) == 2
    assert suffixes.keep_first(none).count() == 0


def test_scan_covers_every_window():
    texts = [prose(i, 50 + 40 * i).encode() for i in range(5)] + [b"x" * 99, b"q" * 100]
    found = np.concatenate(list(suffixes.occurrences(list(range(len(texts))), texts)))
    for d, t in enumerate(texts):
        mine = found[found["doc"] == d]
        windows = sorted(p for a, m in zip(mine["at"].tolist(), mine["more"].tolist()) for p in range(a, a + m + 1))
        assert windows == list(range(max(0, len(t) - 99)))


def test_equal_windows_share_their_trigger():
    passage = prose(9, 60).encode()
    a = np.concatenate(list(suffixes.occurrences([0, 1], [b"left " * 9 + passage + b" end" * 30, b"other" * 31 + passage])))

    def place(doc, start):  # trigger's place in the window that starts there
        r = a[(a["doc"] == doc) & (a["at"] <= start) & (start <= a["at"].astype(int) + a["more"])][0]
        return int(r["at"]) + int(r["off"]) - start, int(r["k"])

    for p in range(len(passage) - 99):
        assert place(0, 45 + p) == place(1, 155 + p)


@pytest.mark.parametrize("seed", range(4))
def test_dictionary(seed):
    """Windows of occurrences, resolved by the two orders, against a dictionary of windows."""
    r = random.Random(seed)
    trigger = bytes(r.randrange(97, 100) for _ in range(32))
    asks, contents = [], []
    for doc in range(40):
        left = r.randint(0, 68)
        more = r.randint(0, left)
        size = 100 + more
        data = bytes(r.choice(b"ab") if r.random() < 0.1 else 97 for _ in range(left)) + trigger
        data = (data + bytes(r.choice(b"cd") if r.random() < 0.05 else 99 for _ in range(200)))[:size]
        asks.append((5, doc // 2, 300 * (doc % 2), more, left, 0))
        contents.append(data)
    a = np.array(asks, suffixes.ASK)
    order = np.random.default_rng(seed).permutation(len(a))
    got = suffixes.dictionary_repeats(a[order], [contents[i] for i in order])
    covered = {(int(d), p) for d, s, e in got.tolist() for p in range(s, e)}
    seen, want = set(), set()
    for (_, doc, at, more, _, _), data in sorted(zip(asks, contents), key=lambda x: (x[0][1], x[0][2])):
        for p in range(more + 1):
            w = data[p : p + 100]
            if w in seen:
                want |= {(doc, at + p + i) for i in range(100)}
            seen.add(w)
    assert covered == want


def test_more_texts_of_a_key_than_16_bits(spark):
    n = 70_000
    df = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    df = df.union(spark.createDataFrame([(6, "a"), (6, "a"), (6, "b"), (None, "c"), (4, "d"), ((1 << 63) - 1, "c"), (-(1 << 63), "e")], "doc_id bigint, text string"))
    rows = suffixes._keyed(df, "doc_id", "text").select("doc_id", "__doc", "text").collect()
    assert len(rows) == n + 7
    assert len({(r.doc_id, r.text) for r in rows}) == len({r["__doc"] for r in rows}) == n + 6
    inorder = [r.doc_id for r in sorted(rows, key=lambda r: r["__doc"])]
    assert inorder == sorted(inorder, key=lambda k: (k is None, k or 0))


def test_texts_of_one_key_beside_large_keys(spark):
    """A key of many texts takes nothing from the next key's text; keys may be of any size."""
    big, x, y = 1 << 60, "".join(f"{i:04x}" for i in range(100)), "".join(f"{i:04x}" for i in range(500, 600))
    df = spark.createDataFrame([(big, x), (big, "other"), (big + 1, x + y), (-big, y)], "doc_id bigint, text string")
    got = {(r.doc_id, bytes(r["__kept"])) for r in suffixes.remove_repeats(df).collect()}
    assert got == {(big, x.encode()), (big, b"other"), (big + 1, b""), (-big, y.encode())}


def test_any_column_names(spark):
    names = ["__kept", "__doc", "__was", "__text", "__clean", "__spans", "a.b", "bucket", "kind"]
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"{i} {passage}", *[f"{n}{i}" for n in names]) for i in range(4)], ["doc_id", "text", *names])
    got = suffixes.keep_first(df)
    assert got.columns == df.columns
    rows = {r.doc_id: list(r) for r in got.collect()}
    assert all(rows[i][2:] == [f"{n}{i}" for n in names] for i in range(4))
    assert len(rows[0][1]) > 200 and all(len(rows[i][1]) < 10 for i in (1, 2, 3))


def test_triggers_cut_a_prefix_free_parse():
    """Phrases overlap by their triggers, and none ends with the beginning of another but for these."""
    data = np.frombuffer(prose(3, 4000).encode(), np.uint8)
    h32, _ = suffixes._hashes(data)
    cuts = np.flatnonzero(suffixes._level(h32) == 0)
    assert len(data) / 60 < len(cuts) < len(data) / 15
    phrases = {data[a : b + suffixes.TRIGGER].tobytes() for a, b in zip(cuts, cuts[1:])}
    ends = sorted({p[i:] for p in phrases for i in range(len(p) - suffixes.TRIGGER)})
    assert not any(b.startswith(a) for a, b in zip(ends, ends[1:]) if a != b)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_of_the_parse(seed):
    """Order and common prefixes of ranked phrases are those of the bytes."""
    r = random.Random(seed)
    base = prose(seed, 400).encode()
    rights = []
    for _ in range(120):
        at = r.randrange(0, 40) * 20
        x = bytearray(base[at : at + r.randint(40, 100)])
        if r.random() < 0.5:
            x[r.randrange(32, len(x))] = 48
        rights.append(bytes(x))
    flat, sizes = np.frombuffer(b"".join(rights), np.uint8), np.array([len(x) for x in rights])
    rows, text, n = suffixes.parse_rows(flat, np.cumsum(sizes) - sizes, sizes)
    assert rows.shape[1] > 1
    order, common = suffixes.parse_order(np.zeros(len(rights), np.uint64), rows, text, n)
    got = [rights[i] for i in order]
    assert got == sorted(rights)
    for a, b, c in zip(got, got[1:], common[1:].tolist()):
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == want


def test_text_beyond_eight_megabytes(spark):
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, 9_000_000)))
    passage = long[8_700_000:8_700_400]
    df = spark.createDataFrame([(1, long + "-" + long[5:305]), (2, "=" + passage + "=")], "doc_id bigint, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r["__spans"]] for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: [(9_000_001, 9_000_301)], 2: [(1, 401)]}


@pytest.mark.parametrize("seed", range(2))
def test_small_alphabets(spark, seed):
    """Texts full of repeats of all lengths, with triggers dense and rare."""
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 150))) for _ in range(12)] + ["c" * 70, "ab" * 40]
    check(spark, ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(60)])


def test_contents_are_combined_in_parts(monkeypatch):
    """Memory doesn't grow with the contents of a task, and parts give what all at once do."""
    import tracemalloc

    rng = np.random.default_rng(3)
    m = 30_000
    a = np.zeros(m, suffixes.ASK)
    a["k"], a["doc"] = rng.integers(1, m // 20, m), np.sort(rng.integers(0, m, m))
    a["at"], a["more"], a["off"] = np.arange(m) * 200, 40, 60
    pool = [rng.integers(97, 123, 140).astype(np.uint8).tobytes() for _ in range(50)]
    contents = [pool[i][:60] + pool[k % 50][60:140] for i, k in zip(rng.integers(0, 3, m).tolist(), a["k"].tolist())]
    tracemalloc.start()
    parts = suffixes.dictionary_repeats(a, contents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    monkeypatch.setattr(suffixes, "CONTENTS_AT_ONCE", m)
    assert len(parts) and (parts == suffixes.dictionary_repeats(a, contents)).all()
    monkeypatch.setattr(suffixes, "CONTENTS_AT_ONCE", 1)
    assert (parts == suffixes.dictionary_repeats(a, contents)).all()
