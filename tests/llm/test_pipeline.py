import base64
import hashlib
import os
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_mixing import brute_targets

from sluice.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "tokens"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    rows = got.collect()
    assert rows and all(r.n_tokens == len(r.ids) > 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_edges(spark, docs, none):
    """Nulls, repeats and further columns pass through every stage, an empty table too."""
    for df, some in ((docs, True), (none, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, DATA)
            if name != "tokens":
                assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
            df = out
        assert (df.count() > 0) == some


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    copies = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).limit(40)
    one = corpus_pipeline.near_duplicates(spark, docs.union(copies), DATA)
    assert one.filter("doc_id >= 1000000").count() == 0
    assert one.select("doc_id").distinct().count() == corpus_pipeline.near_duplicates(spark, docs, DATA).count()
    short = corpus_pipeline.repeats(spark, docs.union(copies), DATA)
    assert short.filter("doc_id >= 1000000").agg(F.max(F.length("text"))).first()[0] < 100


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def brute_one_of_each(rows):
    """doc_ids that stay: the least of each component of pairs with a Jaccard index of 0.8 or more, by all pairs."""
    sets, root = [], list(range(len(rows)))
    for r in rows:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in words_of(r.text)]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {r.doc_id for i, r in enumerate(rows) if top(i) == i}


def brute_first(rows, n=100):
    """doc_id -> the text without the code points that lie, in part or whole, in a window of n bytes that starts earlier too."""
    seen, out = set(), {}
    for r in rows:
        data = (r.text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            if data[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(data[i : i + n])
        at, kept = 0, []
        for c in r.text or "":
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        out[r.doc_id] = "".join(kept)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_stage_against_brute_force(spark, tmp_path):
    def step(name, df):
        dict(corpus_pipeline.STAGES)[name](spark, df, DATA).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    def by_id(df):
        return sorted(df.collect(), key=lambda r: r.doc_id)

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    chain = toxicity.fit(docs, toxicity.label_categories(spark.read.parquet(f"{DATA}/labels.parquet")), toxicity.CATEGORIES)
    p = toxicity.probabilities(chain, toxicity.Words(chain.index), [r.text or "" for r in by_id(docs)])
    at = toxicity.CATEGORIES.index("toxic")
    clean = step("toxicity", docs)
    assert by_id(clean) == [r for r, x in zip(by_id(docs), p[:, at]) if x < chain.thresholds[at]]

    one = step("near_duplicates", clean)
    stays = brute_one_of_each(by_id(clean))
    assert by_id(one) == [r for r in by_id(clean) if r.doc_id in stays]

    first = step("repeats", one)
    want = brute_first(by_id(one))
    assert {r.doc_id: r.text or "" for r in first.collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in first.collect())

    mixed = step("mixing", first)
    sizes, got = Counter(), Counter()
    pieces, before = defaultdict(list), {r.doc_id: r for r in first.collect()}
    for r in before.values():
        sizes[r.source] += len(words_of(r.text))
    for r in mixed.collect():
        pieces[r.doc_id].append(words_of(r.text))
        got[r.source] += len(pieces[r.doc_id][-1])
        assert r.n_chars == len(r.text)
    target = brute_targets(dict(sizes))
    assert all(abs(got[s] - target[s]) <= max(3, 0.002 * target[s]) for s in sizes)
    for k, parts in pieces.items():
        whole = words_of(before[k].text)
        assert sum(map(len, parts)) <= 3 * len(whole) and not Counter(w for x in parts for w in x) - Counter(whole * 3)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in step("tokens", mixed).collect()) == want


def test_links_that_the_search_misses(spark, monkeypatch):
    """Near copies are found whatever candidates SimHash gives, even none."""
    import random

    from sluice.llm import copies

    r = random.Random(5)
    frequent = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [f"u{r.randrange(5000)}" for _ in range(r.choice([3, 8, 30, 120]))] + (frequent if i % 2 else [])
        for c in range(3):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_one_of_each(df.collect())
    assert 60 <= len(want) < 150
    monkeypatch.setattr(copies, "OFTEN", 1)
    assert {x.doc_id for x in copies.keep_one(df).collect()} == want
    nothing = spark.createDataFrame([], "u long, v long, n long, d int")
    monkeypatch.setattr(copies, "candidates", lambda *_: nothing)
    assert {x.doc_id for x in copies.keep_one(df).collect()} == want


def test_few_pairs_are_compared_whole(spark, monkeypatch):
    """Texts that share a passage meet by its shingles, but too few of them to be compared; all near copies are."""
    import random

    import numpy as np

    from sluice.llm import copies

    r = random.Random(7)
    passage, rows = [f"p{i}" for i in range(12)], []
    for i in range(40):
        rows.append((i, " ".join([f"u{r.randrange(10**9)}" for _ in range(60)] + passage + [f"u{r.randrange(10**9)}" for _ in range(60)])))
    for i in range(4):
        words = rows[i][1].split()
        words[5] = words[-5] = "x"
        rows.append((40 + i, " ".join(words[: len(words) - i])))
    monkeypatch.setattr(copies, "OFTEN", 1000)  # so that the passage is among the first shingles
    asked, compare = [], copies._compare

    def count(pairs, wholes, least, bounded=True):
        asked.extend([] if bounded else pairs.collect())
        return compare(pairs, wholes, least, bounded)

    nothing = spark.createDataFrame([], "u long, v long, n long, d int")
    monkeypatch.setattr(copies, "candidates", lambda *_: nothing)
    monkeypatch.setattr(copies, "_compare", count)
    got = {x.doc_id: x.component_id for x in copies.near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 40 if i >= 40 else i for i in range(44)}
    assert len(asked) == 4

    s = np.array([r.getrandbits(64) for _ in range(1000)], np.uint64)
    keys = np.frombuffer(copies.key_bytes(s), np.uint8).reshape(-1, copies.KEY_BYTES)
    columns = [np.array([r.randrange(-(2**m), 2**m) for _ in range(1000)], np.int64) for m in (60, 3, 20)]
    back = copies.unsqueeze(copies.squeeze(keys, columns), 3)
    assert (back[0].astype(np.uint64) == s >> np.uint64(64 - 8 * copies.KEY_BYTES)).all() and (back[1:] == columns).all()


def test_shuffles_no_longer_held_go(spark):
    """near lets go of its shuffles' files step by step, not when a collection happens to come."""
    import time

    from sluice.llm.common import let_go

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    let_go(spark)
    time.sleep(2)
    df = spark.range(1000).repartition(7, "id")
    before = disk.getAllFiles().size()
    df.collect()
    most = disk.getAllFiles().size()
    assert most > before
    del df
    let_go(spark)
    for _ in range(100):
        if disk.getAllFiles().size() < most:
            return
        time.sleep(0.1)
    raise AssertionError("the shuffle's files are still there")
