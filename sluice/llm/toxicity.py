"""Toxicity by a classifier chain.

The categories are predicted one after another. Each is a logistic model over hashed words
and 4- and 5-grams of words, and over the log-odds of the categories before it. While the
chain is fitted those earlier log-odds come from models that haven't seen the row (out of
fold); later they come from the earlier links themselves. The chain learns from a bounded
sample of labelled rows; it scores every word of every text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, column, cut, held, strings

BUCKETS = 1 << 18

#: Labelled rows that the chain learns from at most, those with the least hash of their key.
TRAIN_ROWS = 8000

#: Features of a category at most, the least rows that hold one, and its least z-score.
FEATURES, LEAST_ROWS, LEAST_Z = 800, 3, 4.0

FOLDS, TASKS, STEPS, RATE, PENALTY = 3, 12, 100, 0.2, 1e-4

#: Words whose features a worker remembers at most.
MEMO_WORDS = 120_000

WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    found = {w} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in found]


class Words(dict):
    """Word -> the chosen features it has."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = tuple({self.index[g] for g in grams(word) if g in self.index})
        return found


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    index: dict[int, int]  # bucket -> feature
    weights: np.ndarray  # features x categories
    links: np.ndarray  # [later, earlier]: weight of an earlier category's log-odds
    bias: np.ndarray
    thresholds: np.ndarray

    def digest(self) -> str:
        """Names the chain by what it holds."""
        h = hashlib.sha256(repr((self.categories, sorted(self.index.items()))).encode())
        for a in (self.weights, self.links, self.bias, self.thresholds):
            h.update(np.ascontiguousarray(a, np.float64).tobytes())
        return h.hexdigest()


def _text_features(words: Words, text: str) -> list[int]:
    return sorted(set().union(*map(words.__getitem__, set(WORD.findall(text.lower())))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _train(at: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch Adam on the given rows; (at, feature) are the pairs of presence."""
    use = rows[at]
    at, feature = at[use], feature[use]
    m, k = len(y), extra.shape[1]
    w = np.zeros(n + k + 1)
    share = np.clip(y[rows].mean() if rows.any() else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    size = max(1, int(rows.sum()))
    for step in range(1, STEPS + 1):
        z = np.bincount(at, weights=w[feature], minlength=m) + extra @ w[n:-1] + w[-1]
        e = np.where(rows, _sigmoid(z) - y, 0.0)
        g = np.concatenate([np.bincount(feature, weights=e[at], minlength=n), extra.T @ e, [e.sum()]]) / size
        g[:-1] += PENALTY * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:n], w[n:-1], float(w[-1])


def _cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold with the best F1 out of fold, kept in 0.5 to 0.9; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    best = int(f1.argmax())
    low = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order[best]] + low) / 2, 0.5, 0.9))


def fit(df: DataFrame, labels: DataFrame, categories: tuple[str, ...], key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """labels: key and a 0/1 column for each category, in the chain's order.

    Only labelled rows with all categories and a text are learnt from, `rows` of them at most
    (those with the least hash of their key, so reruns agree); a key that is labelled twice
    counts by its largest values. Without labelled rows every probability is 0.
    """
    bounded_batches(df.sparkSession)
    named = labels.dropna(subset=[key, *categories]).groupBy(F.col(key).alias("k")).agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)])
    chosen = named.orderBy(F.xxhash64("k"), "k").limit(rows)  # at most `rows` rows: small enough to broadcast
    ys = [f"y{i}" for i in range(len(categories))]
    fold = F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = cut(texts.join(F.broadcast(chosen), "k").select("t", fold, *ys).repartition(TASKS))

    def count(batches):
        found = np.zeros((len(ys) + 1, BUCKETS), np.int32)
        for b in batches:
            marks = np.stack([np.asarray(b.column(2 + i).to_pylist(), np.int32) for i in range(len(ys))]) if b.num_rows else None
            for i, t in enumerate(strings(b.column(0))):
                hit = np.unique(np.fromiter((g for w in set(WORD.findall(t.lower())) for g in grams(w)), np.int64))
                found[0, hit] += 1
                for c in range(len(ys)):
                    if marks[c, i] > 0:
                        found[c + 1, hit] += 1
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(found.tobytes(), 1)], pa.binary())], names=["counts"])

    counts = np.zeros((len(ys) + 1, BUCKETS), np.int64)
    for r in sample.mapInArrow(count, "counts binary").collect():  # TASKS arrays of fixed size
        counts += np.frombuffer(zlib.decompress(r["counts"]), np.int32).reshape(counts.shape)
    sums = sample.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    n, chosen_features = max(1, sums["n"]), set()
    for c, y in enumerate(ys):
        share = np.clip((sums[y] or 0) / n, 1e-6, 1 - 1e-6)
        z = (counts[c + 1] - counts[0] * share) / np.sqrt(np.maximum(counts[0], 1) * share * (1 - share))
        z = np.where(counts[0] >= LEAST_ROWS, np.abs(z), 0)
        top = np.argsort(-z, kind="stable")[:FEATURES]
        chosen_features.update(top[z[top] >= LEAST_Z].tolist())
    index = {b: i for i, b in enumerate(sorted(chosen_features))}

    def extract(batches):
        words = Words(index)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([_text_features(words, t) for t in strings(b.column(0))], pa.list_(pa.int32()))], names=["fold", *ys, "f"])

    got = sample.mapInArrow(extract, "fold int, " + ", ".join(f"{y} int" for y in ys) + ", f array<int>").orderBy("fold", *ys, "f").toArrow()
    lists = got.column("f").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if got.num_rows else np.empty(0, np.int64)
    at, feature = np.repeat(np.arange(got.num_rows), sizes), (lists.flatten().to_numpy().astype(np.int64) if got.num_rows else np.empty(0, np.int64))
    fold_of = got.column("fold").to_numpy()
    k, f = len(ys), len(index)
    weights, links, bias, cutoffs = np.zeros((f, k)), np.zeros((k, k)), np.full(k, -30.0), np.full(k, 0.5)
    odds = np.zeros((got.num_rows, k))
    for c, y in enumerate(ys):
        if not got.num_rows:
            break
        truth = (got.column(y).to_numpy() > 0).astype(float)
        extra = odds[:, :c]
        for i in range(FOLDS):
            w, a, b0 = _train(at, feature, extra, truth, fold_of != i, f)
            z = np.bincount(at, weights=w[feature], minlength=len(truth)) + extra @ a + b0
            odds[fold_of == i, c] = np.clip(z, -30, 30)[fold_of == i]
        cutoffs[c] = _cutoff(_sigmoid(odds[:, c]), truth)
        weights[:, c], links[c, :c], bias[c] = _train(at, feature, extra, truth, np.ones(len(truth), bool), f)
    return Chain(tuple(categories), index, weights, links, bias, cutoffs)


def probabilities(chain: Chain, words: Words, texts: list[str]) -> np.ndarray:
    z = np.zeros((len(texts), len(chain.categories)))
    for i, t in enumerate(texts):
        z[i] = chain.weights[_text_features(words, t)].sum(axis=0)
    for c in range(len(chain.categories)):
        z[:, c] = np.clip(z[:, c] + z[:, :c] @ chain.links[c, :c] + chain.bias[c], -30, 30)
    return np.where(chain.bias <= -30, 0.0, _sigmoid(z))


def predict(chain: Chain, df: DataFrame, text: str = "text") -> Column:
    """A struct of each category's probability for the whole text.

    A null text counts as empty. Repeated rows get the same, an empty table gives no rows, and
    texts of any length are scored whole.
    """
    bounded_batches(df.sparkSession)
    sent, name = df.sparkSession.sparkContext.broadcast(chain), chain.digest()

    kinds = ", ".join(f"`{c}` double" for c in chain.categories)

    @F.arrow_udf(kinds)
    def score(part: pa.Array) -> pa.Array:
        p = probabilities(sent.value, _memo(sent.value, name), strings(part))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(p.shape[1])], names=list(sent.value.categories))

    return score(column(text))


def _memo(chain: Chain, name: str) -> Words:
    return held("toxicity", name, lambda: Words(chain.index))


#: The chain over `labels`: of low quality, then toxic.
CATEGORIES = ("junk", "toxic")


def label_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from a table with quality and toxic (0 or 1)."""
    junk, toxic = (F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")
    return labels.select("doc_id", junk.alias("junk"), toxic.alias("toxic"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_junk, p_toxic and rejected (toxic at or over the chain's threshold) of each row.

    A null text counts as empty, null doc_ids and repeated rows get a row each, an empty table
    gives none, texts of any length are scored whole, and no other column is carried.
    """
    chain = fit(docs, label_categories(labels), CATEGORIES)
    at = float(chain.thresholds[CATEGORIES.index("toxic")])
    got = docs.select("doc_id", predict(chain, docs).alias("p"))
    return got.select("doc_id", *[F.col("p")[c].alias(f"p_{c}") for c in CATEGORIES], (F.col("p")["toxic"] >= at).alias("rejected"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are (whatever their names), whose text isn't toxic.

    Null texts count as empty and repeated rows are judged alike. Without labels all rows stay.
    """
    chain = fit(docs, label_categories(labels), CATEGORIES)
    at = float(chain.thresholds[CATEGORIES.index("toxic")])
    return docs.filter(F.coalesce(predict(chain, docs)["toxic"] < at, F.lit(True)))
