import os
import zlib

import numpy as np
import pytest

from sluice.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def test_score_is_a_sum_of_grams(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)), np.zeros(2))
    texts = ["Hello wörld", "", "x", "日本" * 50, "abc" * 400]

    def brute(t):
        points = [0, 0, *map(ord, t.lower()), 0, 0]
        total = np.zeros(2)
        for order in (1, 2, 3):
            for i in range(len(t) + 2):
                total += model.weights[langid.buckets(np.array(points[i : i + order], np.uint32), order)[0]]
        return total

    whole = langid.score(model, texts)
    assert whole.shape == (5, 2)
    assert all(np.allclose(s, brute(t), atol=1e-6) for t, s in zip(texts, whole))
    assert np.allclose(langid.score(model, texts[::-1])[::-1], whole)
    monkeypatch.setattr(langid, "SLICE", 7)
    assert np.allclose(langid.score(model, texts), whole)


def test_edges(spark, docs, none):
    model = langid.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {repr(r.doc_id): r for r in langid.predict(docs, model, carry=("ids", "label")).collect()}
    assert got["4"].lang_pred in ("und", "en", "fr") and got["5"].lang_pred == "und" and got["6"].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none)
    assert empty.languages == []
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    got = queries.QUERIES["op3_language"](spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_letters(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["\u00bd \u00b2 \u2163 \u2460 7_", "x \u00bd", "\u65e5", "\u0660"])], "doc_id long, text string")
    model = langid.Model(["a"], np.zeros((langid.BUCKETS, 1)), np.zeros(1))
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {0: "und", 1: "a", 2: "a", 3: "und"}


def test_counts_and_prior_against_brute_force(spark):
    rows = [(1, "abab", "x"), (2, "Ab", "x"), (3, "cc", "y"), (4, None, "y"), (5, "zz", None), (6, "", "x")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"]
    counts = np.full((langid.BUCKETS, 2), 0.5)
    for _, t, g in rows:
        if t is not None and g is not None:
            points = [0, 0, *map(ord, t.lower()), 0, 0]
            for order in (1, 2, 3):
                for i in range(len(points) - order + 1):
                    counts[langid.buckets(np.array(points[i : i + order], np.uint32), order)[0], "xy".index(g)] += 1
    # the zeros of neighbouring texts are shared, which moves grams of zeros alone
    want = np.log(counts / counts.sum(axis=0))
    letters = [langid.buckets(np.array(list(map(ord, g)), np.uint32), len(g))[0] for g in ("a", "ab", "bab", "c", "cc")]
    got = np.exp(model.weights[letters] - model.weights[letters[0]])
    assert np.allclose(got, np.exp(want[letters] - want[letters[0]]))
    assert np.allclose(model.prior, np.log([3 / 4, 1 / 4]))


def test_more_languages_than_a_block(spark, monkeypatch):
    """Every language is learnt, the rarest too; blocks change nothing."""
    rows = [(i, chr(0x4E00 + 7 * g) * 30, f"l{g:03}") for i, g in enumerate([g for g in range(40) for _ in range(1 + g % 3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.fit(df)
    assert len(whole.languages) == 40
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, whole).collect()}
    assert all(want[i][0] == g for i, _, g in rows)
    monkeypatch.setattr(langid, "WIDE", 7)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()}
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
