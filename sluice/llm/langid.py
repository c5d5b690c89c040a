"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of lower-cased code points are gathered on the executors; the
log-probabilities, a matrix of buckets by languages, are broadcast, and texts are scored in
numpy, a batch at a time: the buckets of all grams of the batch pick rows of the matrix, which
are summed for each text. All languages are learnt. Of over WIDE languages the matrix is sent
in blocks of WIDE, each a broadcast of its own that a worker scores by before the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, held, strings, tidy

BUCKETS, ORDERS = 1 << 15, 3

#: Languages of a block of the matrix (64 MB of log-probabilities).
WIDE = 256

#: Rows of each language that the model learns from at most (a share by a hash of the key).
TRAIN_ROWS = 2000

#: Tasks that count the sample.
TRAIN_TASKS = 12

#: Code points that are scored at a time.
SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log-probabilities
    prior: np.ndarray

    def blocks(self) -> list["Model"]:
        """The model by WIDE languages each."""
        return [Model(self.languages[i : i + WIDE], np.ascontiguousarray(self.weights[:, i : i + WIDE]), self.prior[i : i + WIDE]) for i in range(0, len(self.languages), WIDE)]


def has_letter(text: str) -> bool:
    """Letters are what Unicode calls so; numerals and such signs as 1/2 or a superscript aren't."""
    return any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, two zeros before and after each, and where each begins, with the
    zeros before it: no gram of up to three points that starts in a text's part touches another text."""
    parts, starts, at = [np.zeros(2, np.uint32)], [], 2
    for t in texts:
        a = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        starts.append(at - 2)
        parts += [a, np.zeros(2, np.uint32)]
        at += len(a) + 2
    return np.concatenate(parts), np.array(starts, np.int64)


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the gram that starts at each place but the last order - 1."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Sum of log-probabilities of each text's grams for each language."""
    out = np.zeros((len(texts), len(model.languages)))
    points, starts = grams(texts)
    bounds = np.append(starts, len(points) - 2)
    for low in range(int(starts[0]) if len(starts) else 0, int(bounds[-1]), SLICE):
        high = min(low + SLICE, int(bounds[-1]))
        first = int(np.searchsorted(bounds, low, "right")) - 1
        last = int(np.searchsorted(bounds, high, "left"))
        cuts = np.maximum(bounds[first:last], low) - low
        for order in range(1, ORDERS + 1):
            out[first:last] += np.add.reduceat(model.weights[buckets(points[low : high + order - 1], order)], cuts, axis=0)
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learns from rows with text and language, of each language about `rows` at most, by a hash of the key.

    The sample's bound is this parameter; each of its texts is counted whole. Every language is
    learnt, so the matrix has a column for each.
    """
    bounded_batches(df.sparkSession)
    named = df.filter(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).cast("string").alias("g"))
    sizes = {r["g"]: r["count"] for r in named.groupBy("g").count().collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {g: i for i, g in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for g in languages for x in (g, min(1.0, rows / sizes[g]))])
    chance = (F.xxhash64("k").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).cast("double")
    sample = named.filter(chance < share[F.col("g")]).select("g", "t").repartition(TRAIN_TASKS)

    def run(batches):
        counts: dict[int, np.ndarray] = {}

        def out():
            for i, c in counts.items():
                bucket = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(c[bucket])], names=["at", "bucket", "n"])
            counts.clear()

        for b in batches:
            of: dict[int, list[str]] = {}
            for g, t in zip(b.column(0).to_pylist(), strings(b.column(1))):
                of.setdefault(number[g], []).append(t)
            for i, texts in of.items():
                points, _ = grams(texts)
                if i not in counts:
                    if len(counts) >= WIDE:
                        yield from out()
                    counts[i] = np.zeros(BUCKETS, np.int64)
                for order in range(1, ORDERS + 1):
                    counts[i] += np.bincount(buckets(points, order), minlength=BUCKETS)
        yield from out()

    found = sample.mapInArrow(tidy(run), "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    at, bucket, n = (found.column(c).to_numpy() for c in ("at", "bucket", "n"))
    np.add.at(counts, (bucket, at), n)
    size = np.array([sizes[g] for g in languages], float)
    return Model(languages, np.log(counts / counts.sum(axis=0)), np.log(size / size.sum()))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Key, carried columns, lang_pred and score (the language's posterior) of each whole text, of any length.

    `und` with score 0 for a null text, one without letters, or a model without languages.
    Ties go to the language that sorts first. Repeated rows and null keys give a row each; an
    empty table gives none; columns that aren't named are not carried.
    """
    bounded_batches(df.sparkSession)
    sent = [df.sparkSession.sparkContext.broadcast(m) for m in model.blocks()]  # buckets x languages each
    schema = ", ".join([f"`{n}` {df.schema[n].dataType.simpleString()}" for n in (key, *carry)] + ["lang_pred string, score double"])

    def run(batches):
        held("langid")
        for b in batches:
            texts = strings(b.column(b.num_columns - 1))
            known = [bool(sent) and has_letter(t) for t in texts]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, k in enumerate(known) if k]
            if rows:
                some = [texts[i] for i in rows]
                top, total, named = np.full(len(rows), -np.inf), np.zeros(len(rows)), [""] * len(rows)
                for part in sent:
                    m = part.value
                    s = score(m, some) + m.prior
                    best = s.argmax(axis=1)
                    most = s[np.arange(len(rows)), best]
                    for i in np.flatnonzero(most > top):
                        named[i] = m.languages[best[i]]
                    high = np.maximum(top, most)
                    total = total * np.exp(top - high) + np.exp(s - high[:, None]).sum(axis=1)
                    top = high
                for i, name, x in zip(rows, named, 1 / total):
                    names[i], scores[i] = name, float(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, *carry, "lang_pred", "score"])

    return df.select(key, *carry, text).mapInArrow(tidy(run), schema)
