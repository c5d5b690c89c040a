import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import toxicity
from tests_llm_helpers import prose

BAD = ["vrakk", "vrakkel", "zomtunk", "zomtunker", "grelpish"]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(500):
        text, toxic = prose(i, r.randint(20, 200)), i % 6 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
            text = " ".join(w)
        junk = i % 10 == 3
        docs.append((i, text + (" zzqq zzqq zzqq" if junk else ""), "p"))
        if i < 350:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, p string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    rest = [got[i] for i in range(350, 500)]
    right = [r.rejected == (r.doc_id % 6 == 0) for r in rest]
    assert np.mean(right) > 0.97
    assert np.mean([(r.p_junk > 0.5) == (r.doc_id % 10 == 3) for r in rest]) > 0.97
    assert all(0 <= p <= 1 for r in rest for p in (r.p_junk, r.p_toxic))
    again = {r.doc_id: r.p_toxic for r in toxicity.score_documents(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - got[i].p_toxic) < 1e-9 for i in again)


def test_chain_feeds_forward(corpus):
    docs, labels = corpus
    chain = toxicity.fit(docs, toxicity.label_categories(labels), toxicity.CATEGORIES)
    assert np.count_nonzero(chain.links[0]) == 0 and chain.links[1, 1] == 0 and chain.links[1, 0] != 0


def test_later_categories_learn_from_earlier_ones(spark, corpus):
    """A third category that holds where one of the first two does leans on both."""
    docs, labels = corpus
    three = toxicity.label_categories(labels).withColumn("either", F.greatest("junk", "toxic"))
    chain = toxicity.fit(docs, three, ("junk", "toxic", "either"))
    assert chain.links[2, 0] > 0 and chain.links[2, 1] > 0


def brute_probabilities(chain, text):
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    found = {chain.index[g] for w in words for g in toxicity.grams(w) if g in chain.index}
    odds = []
    for c in range(len(chain.categories)):
        z = sum(chain.weights[f, c] for f in found) + chain.bias[c] + sum(o * chain.links[c, e] for e, o in enumerate(odds))
        odds.append(max(-30.0, min(30.0, z)))
    return [1 / (1 + np.exp(-z)) for z in odds]


def test_query_scores_against_brute_force(spark, corpus):
    """Registered columns from a plain sum over the learnt weights, long texts too."""
    docs, labels = corpus
    chain = toxicity.fit(docs, toxicity.label_categories(labels), toxicity.CATEGORIES)
    long = spark.createDataFrame([(9999, prose(77, 30_000) + " vrakk", "p"), (9998, None, "p"), (9997, "", "p")], docs.schema)
    some = docs.filter("doc_id < 60").union(long)
    got = {r.doc_id: r.p for r in some.select("doc_id", toxicity.predict(chain, some).alias("p")).collect()}
    for r in some.collect():
        assert np.allclose([got[r.doc_id][c] for c in chain.categories], brute_probabilities(chain, r.text or ""), atol=1e-9)


def test_training_against_plain_gradient_descent():
    """The fitted weights are those at which the penalised loss is least, near enough."""
    rng = np.random.default_rng(0)
    m, f = 300, 6
    x = rng.random((m, f)) < 0.3
    y = ((x[:, 0] | x[:, 1]) ^ (rng.random(m) < 0.1)).astype(float)
    at, feature = np.nonzero(x)
    w, _, b = toxicity._train(at, feature, np.zeros((m, 0)), y, np.ones(m, bool), f)
    v, c = np.zeros(f), 0.0
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(x @ v + c))) - y
        v, c = v - 0.5 * (x.T @ e / m + toxicity.PENALTY * v), c - 0.5 * e.mean()
    loss = lambda w, b: np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + toxicity.PENALTY / 2 * w @ w
    assert loss(w, b) <= loss(v, c) + 0.002


def test_two_chains_in_one_worker(spark):
    """What a worker remembers of one chain's words is never used for another's."""
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").coalesce(1)
    for i in range(12):
        word = ("alpha", "beta")[i % 2]
        chain = toxicity.Chain(("a",), {toxicity.zlib.crc32(f"^{word}$".encode()) & (toxicity.BUCKETS - 1): 0}, np.array([[3.0 + i]]), np.zeros((1, 1)), np.zeros(1), np.full(1, 0.5))
        got = docs.select(toxicity.predict(chain, docs)["a"].alias("p")).first()[0]
        assert abs(got - 1 / (1 + np.exp(-3.0 - i))) < 1e-9


def test_keep_clean(corpus):
    docs, labels = corpus
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i in range(500) if i % 6}
    assert len(clean - ids) <= 3 and len(ids - clean) <= 3


def test_edges(spark, docs, none, corpus):
    _, labels = corpus
    nothing = labels.filter(F.lit(False))
    got = toxicity.score_documents(docs, nothing).collect()
    assert len(got) == docs.count() and not any(r.rejected for r in got) and {r.p_toxic for r in got} == {0.0}
    assert toxicity.keep_clean(docs, nothing).count() == docs.count()
    assert toxicity.score_documents(none, labels).count() == 0
    odd = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, None, 1), (None, 0, 1), (99, 0, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.keep_clean(docs, odd).columns == docs.columns
    assert toxicity.score_documents(docs, odd).count() == docs.count()
