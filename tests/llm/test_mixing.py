import os
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing, queries


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def brute_seats(votes, seats):
    got = {p: 0 for p in votes}
    for _ in range(seats):
        got[max(sorted(votes), key=lambda p: Fraction(votes[p], 2 * got[p] + 1))] += 1
    return got


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague(spark, seed):
    r = random.Random(seed)
    votes = {i: r.choice([0, 1, 5, r.randint(1, 50), r.randint(1, 5000)]) for i in range(1, r.randint(2, 25))}
    seats = r.choice([0, 1, 3, 17, 500])
    if not sum(votes.values()):
        votes[1] = 1
    df = spark.createDataFrame([("g", i, v, seats) for i, v in votes.items()] + [("h", 1, 7, 5)], "g string, p int, v long, s long")
    got = {(x.g, x.p): x.quota for x in mixing.sainte_lague(df, ["g"], "p", "v", "s").collect()}
    assert got.pop(("h", 1)) == 5
    got = {p: q for (_, p), q in got.items()}
    want = brute_seats(votes, seats)
    assert sum(got.values()) == seats
    # equal quotients may go to either
    low = lambda s: min(Fraction(votes[p], 2 * s[p] - 1) for p in s if s[p])
    assert got == want or (seats and low(got) == low(want))


def make(spark, seed, sources, n):
    r = random.Random(seed)
    rows = [(i, r.choice(sources), "w " * r.choice([0, 1, 3, r.randint(1, 400)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("seed, sources, n", [(1, ["a", "b", None, "é", "Z"], 300), (2, ["x"] * 9 + ["y", "z"], 200), (3, ["q"], 50), (4, [f"s{i}" for i in range(40)], 400)])
def test_mix(spark, seed, sources, n):
    rows, df = make(spark, seed, sources, n)
    got = {r.doc_id: r for r in mixing.mix(df).withColumn("taken", mixing.taken()).collect()}
    sizes, taken = {}, {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
        taken[s] = taken.get(s, 0) + got[i].taken
        assert got[i]["__size"] == len(t.split()) and 0 <= got[i].taken <= 3 * got[i]["__size"]
    target = brute_targets(sizes)
    for i, s, _ in rows:
        assert got[i]["__target"] == pytest.approx(float(target[s]))
        assert got[i]["__source_size"] == sizes[s]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.002 * target[s])
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).withColumn("taken", mixing.taken()).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_rows(spark, docs, none):
    mixed = mixing.rows_of(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    by = {}
    for r in mixing.mix(docs).withColumn("taken", mixing.taken()).collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.taken
    words = {}
    for r in out:
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {k: v for k, v in by.items() if v}
    assert mixing.rows_of(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_no_words(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [r["__target"] for r in mixing.mix(df).collect()] == [0.0, 0.0]
    assert mixing.rows_of(df).count() == 0
    assert mixing.mix(df).agg(F.sum(mixing.taken())).first()[0] == 0


NAMES = ["__size", "__source", "__one", "__key", "__texts", "__shard", "__kept", "__doc", "__was", "__text", "__clean", "__k", "a.b", "size"]


def test_any_column_names(spark):
    df = spark.createDataFrame([(i, "w " * 50, "s", 100, *[f"{n}{i}" for n in NAMES]) for i in range(5)], ["doc_id", "text", "source", "n_chars", *NAMES])
    got = mixing.rows_of(df)
    assert got.columns == df.columns
    for r in got.collect():
        assert list(r)[4:] == [f"{n}{r.doc_id}" for n in NAMES]
    with pytest.raises(ValueError, match="made here"):
        mixing.mix(df.select("doc_id", "text", "source", "__key"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    """The registered columns against brute force and SQL."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op2_mixing"](spark, sf).collect()}
    sizes, taken = {}, {}
    for r in docs:
        x, n = got[r.doc_id], len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert x["size"] == n and 0 <= x.taken <= 3 * n
        sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + n, taken.get(r.source, 0) + x.taken
    target = brute_targets(sizes)
    for r in docs:
        assert got[r.doc_id].source_size == sizes[r.source] and got[r.doc_id].target == pytest.approx(float(target[r.source]))
    assert all(abs(taken[s] - target[s]) <= max(3, 0.002 * target[s]) for s in sizes)
    con = duckdb.connect()
    want = con.sql(f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{sf}/documents.parquet')
        SELECT doc_id, size, sum(size) OVER (PARTITION BY source) FROM d""").fetchall()
    assert {(i, s, int(t)) for i, s, t in want} == {(r.doc_id, r["size"], r.source_size) for r in got.values()}
