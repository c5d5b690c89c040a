import hashlib
import os
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import queries, syncmers
from tests_llm_helpers import prose


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_text(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def hash_two(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), first))


def brute(text):
    w = [x for word in re.findall(r"[^\x20\x09-\x0D]+", text) for x in ([word] if len(word) <= 12 else word)]
    if not w:
        return []
    if len(w) < 4:
        return [(hash_text(" ".join(w)) & 0x7FFFFFFF) << 32]
    h = [hash_text(x) for x in w]
    s = [hash_two(a, b) for a, b in zip(h, h[1:])]
    chosen = {}
    for i in range(len(w) - 3):
        if min(s[i : i + 3]) in (s[i], s[i + 2]):
            chosen.setdefault(hash_two(s[i], s[i + 2]) & 0x7FFFFFFF, i)
    return [h << 32 | i for h, i in sorted(chosen.items())[:64]]


def alike(a, b):
    a, b = ({x >> 32: x & 0xFFFFFFFF for x in y} for y in (a, b))
    u = sorted({*a, *b})[:64]
    if not u:
        return 1.0
    moves = [m for _, m in sorted((a[h], b[h] - a[h]) for h in u if h in a and h in b)]
    lined = [len(moves) == 1 or m in (moves[i - 1] if i else None, moves[i + 1] if i + 1 < len(moves) else None) for i, m in enumerate(moves)]
    return sum(lined) / len(u)


def check(df):
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: -r[0])
    got = syncmers.compare_edited(df)
    got = got.withColumn("a", syncmers.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("b", syncmers.likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        r = found[i]
        assert (r.n_chars, r.edited) == (n, edited)
        assert hashlib.sha256(r.edited.encode()).digest() == hashlib.sha256(edited.encode()).digest()
        assert list(r.fingerprint) == brute(t) and list(r.edited_fingerprint) == brute(edited) and list(r.next_fingerprint) == brute(after)
        assert abs(r.a - alike(brute(t), brute(edited))) < 1e-9 and abs(r.b - alike(brute(t), brute(after))) < 1e-9


def test_against_brute_force(unique, spark):
    check(unique)
    check(unique.filter("doc_id < 1"))
    check(unique.filter("doc_id < 2"))


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    keys = random.Random(4).sample(range(-(10**12), 10**12), 120)
    df = spark.createDataFrame([(k, prose(k, 20)) for k in keys], "doc_id bigint, text string")
    tops = syncmers.ranges(df, "doc_id", 7)
    assert len(tops) > 10
    check(df)


def test_edges(docs, none):
    got = syncmers.compare_edited(docs)
    assert got.count() == docs.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(tuple(r.fingerprint))
    assert by[0] == by[1] and by[5] == by[6] == {()} and len(by[4]) == 2 and len(by[None]) == 2
    assert syncmers.compare_edited(none).count() == 0
    only_null = docs.filter("doc_id IS NULL")
    assert syncmers.compare_edited(only_null).count() == 2


def test_anchors_line_texts_up(spark):
    base = prose(8, 60)
    df = spark.createDataFrame([(base, prose(9, 10) + " " + base)], "a string, b string")
    got = df.select(syncmers.sketch(F.col("a")).alias("a"), syncmers.sketch(F.col("b")).alias("b")).select(syncmers.matches(F.col("a"), F.col("b")).alias("m"), F.size("a").alias("n")).first()
    assert len(got.m) == got.n > 20 and {x.move for x in got.m} == {10}
    assert [x.place for x in got.m] == sorted(x.place for x in got.m)
    text = spark.createDataFrame([([1, 255],)], "f array<bigint>").select(syncmers.written(F.col("f"))).first()[0]
    assert text == "000000000000000100000000000000ff"


def test_shared_words_out_of_line_do_not_count(spark):
    """The same sentences in another order share anchors, which do not line up across their borders."""
    parts = [prose(i, 6) for i in range(20)]
    same, other = " ".join(parts), " ".join(parts[::-1])
    df = spark.createDataFrame([(same, same, other)], "a string, b string, c string")
    near = lambda x, y: syncmers.likeness(syncmers.sketch(F.col(x)), syncmers.sketch(F.col(y)))
    got = df.select(near("a", "b").alias("b"), near("a", "c").alias("c"), F.size(syncmers.matches(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("c")))).alias("n")).first()
    assert got.b == 1.0 and got.c < got.n / 64


def test_scripts_without_spaces(spark):
    """One code point before a passage moves its anchors by one place and changes none of the rest."""
    passage = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(300))
    df = spark.createDataFrame([(passage, "\u4e8c" + passage)], "a string, b string")
    got = df.select(syncmers.likeness(syncmers.sketch(F.col("a")), syncmers.sketch(F.col("b"))).alias("x")).first()
    assert got.x > 0.9


def test_long_text_and_other_columns(spark):
    long = prose(5, 40_000)
    df = spark.createDataFrame([(1, long, "x"), (2, long + " end", "y")], "doc_id long, text string, t string")
    got = {r.doc_id: r for r in syncmers.compare_edited(df).collect()}
    assert got[1].n_chars == len(long) and list(got[1].fingerprint) == brute(long)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query(spark):
    """The registered columns against brute force."""
    sf = "/root/testdata/sf0.001"
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op4_syncmers"](spark, sf).collect()}
    assert len(got) == len(rows)
    hexed = lambda f: "".join(f"{x:016x}" for x in f)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r, f, e = got[i], brute(t), brute(edited)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e))
        assert abs(r.near_edited - alike(f, e)) < 1e-9 and abs(r.near_next - alike(f, brute(after))) < 1e-9
