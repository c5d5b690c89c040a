"""Orthogonal matching pursuit: flows' totals from the sketch.

Each step takes the flow that correlates best with the residual, solves least squares on all
flows taken, and subtracts. The inverse of the support's Gram matrix grows by its Schur
complement, which is the square of the pivot that a Cholesky factor would get. Beyond DENSE flows
no inverse is held: the same update comes from a sparse system that conjugate gradients solve
in the support's own counters, so memory grows with the support and not with its square.
Steps run in numpy: on the driver for one sketch of up to LOCAL_FLOWS flows, in one task a
group for many sketches, and over partitioned flows, with only the pick and the residual
travelling, for one sketch of more.

Fewer steps than flows are a matter of one sketch. A step for each flow asks for every total, and
no more totals come back than a sketch has counters, so there keys are dealt by a hash over as many
sketches as give a flow about COLUMNS_A_FLOW columns, and each sketch has its own pursuit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.cluster import ship
from sluice.config import DEFAULT, SketchConfig
from sluice.functions.hashing import with_cms_columns
from sluice.operators.flows import flow_table, numbered
from sluice.operators.sketch import build_sketch, flatten

#: Flows that are brought to the driver at most (40 bytes each).
LOCAL_FLOWS = 2_000_000

#: Columns of a sketch for each of its flows, about, where every total is asked for (1,024 flows to 16,384 columns).
COLUMNS_A_FLOW = 16

#: Flows of a support up to which its inverse is held (128 MB), and the accuracy of a sparse solution beyond.
DENSE, ACCURACY = 4096, 1e-13


class Solver:
    """Least squares on a support that grows by one flow a time."""

    def __init__(self, y: np.ndarray, config: SketchConfig = DEFAULT):
        self.y, self.r, self.config = y, y.copy(), config
        self.positions = np.empty((0, config.rows), np.int64)
        self.inverse, self.rhs, self.x = np.zeros((64, 64)), np.empty(0), np.empty(0)  # room is doubled when it is used up

    def _times_gram(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.positions.ravel(), weights=np.repeat(w, self.config.rows), minlength=len(self.y))[self.positions].sum(axis=1)

    def _sparse(self, v: np.ndarray) -> np.ndarray:
        """The inverse Gram matrix times v, by conjugate gradients."""
        w, r = np.zeros(len(v)), v.copy()
        p, size = r.copy(), float(r @ r)
        least = size * ACCURACY**2
        for _ in range(10 * len(v)):
            if size <= least:
                break
            q = self._times_gram(p)
            a = size / float(p @ q)
            w += a * p
            r -= a * q
            old, size = size, float(r @ r)
            p = r + size / old * p
        return w

    def add(self, positions: np.ndarray) -> bool:
        """Takes a flow in; False where it can't be told from those taken (it then weighs 0)."""
        k = len(self.x)
        if k >= DENSE:
            self.inverse = np.empty((0, 0))
            v = (self.positions == positions).sum(axis=1).astype(float)
            w = self._sparse(v) if v.any() else np.zeros(k)
            pivot = float(len(positions)) - float(v @ w)
            if pivot <= max(self.config.least_pivot, 1e-9):
                return False
            return self._take(positions, v, w, pivot)
        v = (self.positions == positions).sum(axis=1).astype(float)
        inverse = self.inverse[:k, :k]
        met = np.flatnonzero(v)  # few flows share counters, so nearly all of the update is zero
        w = inverse[:, met] @ v[met]
        pivot = float(len(positions)) - float(v @ w)
        if pivot <= self.config.least_pivot:
            return False
        if k == len(self.inverse):
            grown = np.zeros((2 * k, 2 * k))
            grown[:k, :k] = inverse
            self.inverse = grown
            inverse = grown[:k, :k]
        near = np.flatnonzero(w)
        inverse[np.ix_(near, near)] += np.outer(w[near], w[near] / pivot)
        self.inverse[k, :k] = self.inverse[:k, k] = -w / pivot
        self.inverse[k, k] = 1 / pivot
        return self._take(positions, v, w, pivot)

    def _take(self, positions: np.ndarray, v: np.ndarray, w: np.ndarray, pivot: float) -> bool:
        self.positions = np.vstack([self.positions, positions])
        self.rhs = np.append(self.rhs, self.y[positions].sum())
        new = (self.rhs[-1] - v @ self.x) / pivot
        self.x = np.append(self.x - w * new, new)
        explained = np.bincount(self.positions.ravel(), weights=np.repeat(self.x, self.config.rows), minlength=len(self.y))
        self.r = self.y - explained
        return True

    def norm(self) -> float:
        return float(np.sqrt(np.square(self.r).sum()))


def cholesky(gram: np.ndarray, least_pivot: float = DEFAULT.least_pivot) -> np.ndarray:
    """Lower factor; raises LinAlgError at a pivot that isn't above least_pivot."""
    n = len(gram)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            out[i, j] = (gram[i, j] - out[i, :j] @ out[j, :j]) / out[j, j]
        pivot = gram[i, i] - out[i, :i] @ out[i, :i]
        if pivot <= least_pivot:
            raise np.linalg.LinAlgError("the matrix isn't positive definite")
        out[i, i] = np.sqrt(pivot)
    return out


def cholesky_solve(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    factor = cholesky(gram)
    z = np.zeros(len(b))
    for i in range(len(b)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    for i in range(len(b) - 1, -1, -1):
        z[i] = (z[i] - factor[i + 1 :, i] @ z[i + 1 :]) / factor[i, i]
    return z


def solve_support(gram: DataFrame, rhs: DataFrame) -> DataFrame:
    """flow_id, x: least squares on a small support, from its Gram matrix (p, q, overlap) and right side (flow_id, b).

    A support is as long as the pursuit has steps; it is solved on the driver by Cholesky.
    """
    spark = gram.sparkSession
    b = {r["flow_id"]: r["b"] for r in rhs.collect()}
    ids = sorted(b)
    at = {f: i for i, f in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    for r in gram.collect():
        g[at[r["p"]], at[r["q"]]] = r["overlap"]
    x = cholesky_solve(g, np.array([b[f] for f in ids], float))
    return spark.createDataFrame([(f, float(v)) for f, v in zip(ids, x)], "flow_id bigint, x double")


@dataclass
class Recovered:
    x: np.ndarray
    selected: np.ndarray
    support: list[int]
    norm: float


def _pick(corr: np.ndarray, free: np.ndarray, config: SketchConfig) -> int:
    """Lowest of the free flows with the largest correlation; -1 at or under the tolerance."""
    a = np.where(free, np.abs(corr), -1.0)
    i = int(a.argmax()) if len(a) else -1
    return i if i >= 0 and a[i] > config.least_correlation else -1


def heavy_positions(r: np.ndarray, config: SketchConfig = DEFAULT) -> np.ndarray:
    """The heaviest counters of a residual, over a share of the largest."""
    size = np.abs(r)
    heavy = np.flatnonzero(size > config.heavy_share * size.max())
    return heavy[np.lexsort((heavy, -size[heavy]))][: config.heavy_buckets]


def omp(y: np.ndarray, positions: np.ndarray, most: int, config: SketchConfig = DEFAULT, restricted: bool = False) -> Recovered:
    """y: dense measurements; positions: flows x rows. restricted looks at flows of heavy counters
    only, and at all of them every full_scan_every steps or where those give none: faster with
    many flows, but it may pick in another order."""
    n = len(positions)
    used = np.unique(np.append(positions, np.flatnonzero(y)))  # the other counters are 0 and stay 0
    y, positions = y[used], np.searchsorted(used, positions).reshape(n, config.rows)
    solver, x, free, support = Solver(y, config), np.zeros(n), np.ones(n, bool), []
    by_position = np.argsort(positions.ravel(), kind="stable") if restricted else None
    sorted_positions = positions.ravel()[by_position] if restricted else None
    for step in range(min(most, n)):
        best = -1
        if restricted and step % config.full_scan_every:
            heavy = heavy_positions(solver.r, config)
            low, high = np.searchsorted(sorted_positions, heavy, "left"), np.searchsorted(sorted_positions, heavy, "right")
            near = np.unique(np.concatenate([by_position[a:b] // config.rows for a, b in zip(low, high)] or [np.empty(0, np.int64)]))
            if len(near):
                at = _pick(solver.r[positions[near]].sum(axis=1), free[near], config)
                best = int(near[at]) if at >= 0 else -1
        if best < 0:
            best = _pick(solver.r[positions].sum(axis=1), free, config)
        if best < 0:
            break
        free[best] = False
        support.append(best)
        if not solver.add(positions[best]):
            break
        x[support] = solver.x
        if solver.norm() < config.least_residual:
            break
    return Recovered(x, ~free, support, solver.norm())


def _dense(y: pd.DataFrame, config: SketchConfig) -> np.ndarray:
    out = np.zeros(config.counters)
    out[y["pos"].to_numpy(np.int64)] = y["value"].to_numpy(float)
    return out


FOUND = "flow_id bigint, key bigint, x double, selected boolean"


def flows_of_keys(keys: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """flow_id, key, idx of a list of keys: numbered by `seq` where there is such a column, else by key. Null keys are no flows."""
    first = F.min("seq" if "seq" in keys.columns else "key").alias("first")
    rows = numbered(keys.filter("key IS NOT NULL").groupBy("key").agg(first), "first", "key", "flow_id")
    return with_cms_columns(rows, config=config).select("flow_id", "key", "idx")


def recover_from_sketch(sketch: DataFrame, keys: DataFrame, most: int | None = None, config: SketchConfig = DEFAULT, restricted: bool = False) -> DataFrame:
    """flow_id, key, x, selected: what counters (row, col, value) and the list of keys give back, without a packet.

    keys: key, and seq for the order of the flows where it matters. most: steps at most (None: as
    many as keys). Up to LOCAL_FLOWS keys the loop runs on the driver, beyond over partitions.
    """
    return _recover(flows_of_keys(keys, config), flatten(sketch, config), most, config, restricted)


def _recover(flows: DataFrame, y: DataFrame, most: int | None, config: SketchConfig, restricted: bool) -> DataFrame:
    """flow_id, key, x, selected; flows: flow_id, key, idx."""
    spark = flows.sparkSession
    flows = flows.select("flow_id", "key", "idx").cache()
    try:
        n = flows.count()
        if n > LOCAL_FLOWS:
            return _over_partitions(flows, y, n if most is None else most, config, restricted)
        if not n:
            return spark.createDataFrame([], FOUND)
        got = flows.orderBy("flow_id").toArrow()
    finally:
        flows.unpersist()
    idx = got.column("idx").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n, config.rows)
    found = omp(_dense(y.toPandas(), config), idx + np.arange(config.rows) * config.columns, n if most is None else most, config, restricted)
    out = pa.table({"flow_id": got.column("flow_id"), "key": got.column("key"), "x": pa.array(found.x), "selected": pa.array(found.selected)})
    return spark.createDataFrame(out, FOUND)


def recover(packets: DataFrame, most: int | None = None, config: SketchConfig = DEFAULT, restricted: bool = False) -> DataFrame:
    """flow_id, key, true_x, x, selected of each flow; most: steps at most (None: as many as flows).

    With fewer steps than flows there is one sketch: its measurements are of fixed size. With a
    step for each flow and more flows than one is for there are several (see above), each
    recovered in a task. The true totals are for comparison and take no part. Packets with a null key are left
    out, null weights count 0.
    """
    n = _flows_if_all(packets, most, config)
    if n > _room(config):
        return _with_truth(_over_sketches(packets, n, config, restricted), packets, config)
    flows = flow_table(packets, config)
    return _with_truth(_recover(flows, flatten(build_sketch(packets, config), config), most, config, restricted), packets, config, flows)


def _room(config: SketchConfig) -> int:
    """Flows of a sketch, about, where every total is asked for."""
    return max(1, config.columns // COLUMNS_A_FLOW)


def _flows_if_all(packets: DataFrame, most: int | None, config: SketchConfig) -> int:
    """The number of flows where there is a step for each of them, or else 0."""
    if most is not None and most <= _room(config):
        return 0
    n = packets.agg(F.count_distinct("key")).first()[0]
    return n if most is None or most >= n else 0


def _over_sketches(packets: DataFrame, n: int, config: SketchConfig, restricted: bool) -> DataFrame:
    """key, x, selected of all n flows, from as many sketches as they need."""
    dealt = packets.withColumn("__sketch", _dealt(F.lit(-(-n // _room(config)))))
    return _in_tasks(dealt, ("__sketch",), None, config, restricted).select("key", "x", "selected")


def _dealt(sketches):
    """Which of so many sketches a key belongs to."""
    return F.pmod(F.xxhash64("key"), sketches.cast("bigint"))


def _with_truth(found: DataFrame, packets: DataFrame, config: SketchConfig, flows: DataFrame | None = None) -> DataFrame:
    flows = flow_table(packets, config) if flows is None else flows
    return found.select("key", "x", "selected").join(flows.select("flow_id", "key", "true_x"), "key").select("flow_id", "key", "true_x", "x", "selected")


def recover_grouped(packets: DataFrame, by: str, most: int | None = None, config: SketchConfig = DEFAULT, restricted: bool = False) -> DataFrame:
    """One recovery for each value of `by`, side by side: by, key, true_x, x, selected.

    Packets are summed by group and key, and by group and counter, before they are shuffled to
    their group; a group's task holds its flows and one sketch. A group with a step for each
    of more flows than one sketch is for has several sketches, and a task for each.
    """
    sizes = packets.groupBy(by).agg(F.count_distinct("key").alias("__n"))
    large = sizes.filter(F.col("__n") > _room(config))
    if most is not None:
        large = large.filter(F.col("__n") <= most)
    large = large.select(F.col(by).alias("__by"), F.ceil(F.col("__n") / _room(config)).alias("__sketches"))  # few: each stands for more flows than a sketch
    dealt = packets.join(F.broadcast(large), F.col(by).eqNullSafe(F.col("__by")), "left")
    dealt = dealt.withColumn("__sketch", _dealt(F.coalesce("__sketches", F.lit(1)))).drop("__by", "__sketches")
    return _in_tasks(dealt, (by, "__sketch"), most, config, restricted).select(by, "key", "true_x", "x", "selected")


def _in_tasks(packets: DataFrame, by: tuple[str, ...], most: int | None, config: SketchConfig, restricted: bool) -> DataFrame:
    """The columns of `by`, key, true_x, x, selected: a recovery in a task for each value of `by`."""
    ship(packets.sparkSession)
    kinds = "".join(f"`{c}` {packets.schema[c].dataType.simpleString()}, " for c in by)
    packets = packets.filter("key IS NOT NULL")
    totals = packets.groupBy(*by, "key").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("value"), F.min("seq").alias("seq"))
    flows = totals.select(*by, "key", "seq", "value", F.lit(-1).alias("pos"))
    y = build_sketch(packets, config, by).select(*by, F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("value").cast("double").alias("value"), (F.col("row") * config.columns + F.col("col")).cast("int").alias("pos"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["pos"] < 0].sort_values(["seq", "key"])
        keys = own["key"].to_numpy(np.int64)
        found = omp(_dense(pdf[pdf["pos"] >= 0], config), positions_of(keys, config), len(keys) if most is None else most, config, restricted)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "key": keys, "true_x": own["value"].to_numpy(), "x": found.x, "selected": found.selected})

    return flows.unionByName(y).groupBy(*by).applyInPandas(run, f"{kinds}key bigint, true_x double, x double, selected boolean")


def positions_of(keys: np.ndarray, config: SketchConfig = DEFAULT) -> np.ndarray:
    """Flat positions of keys in numpy, the same as the column expressions'."""
    from sluice.config import MIX

    out = []
    with np.errstate(over="ignore"):
        for row, seed in enumerate(config.cms_seeds[: config.rows]):
            h = keys.view(np.uint64) ^ np.uint64(seed)
            for m in MIX:
                h = (h ^ h >> np.uint64(33)) * np.uint64(m)
            out.append((h ^ h >> np.uint64(33)).astype(np.int64) & config.columns - 1 | row * config.columns)
    return np.stack(out, axis=1)


def recover_distributed(packets: DataFrame, most: int | None = None, config: SketchConfig = DEFAULT, restricted: bool = False) -> DataFrame:
    """As recover, with flows left on the executors whatever their number.

    Fewer steps than flows take a job each. With a step for each flow (None) there is one job, a
    task for each of as many sketches as the flows need.
    """
    n = packets.agg(F.count_distinct("key")).first()[0] if most is None else _flows_if_all(packets, most, config)
    if most is None or n:
        return _with_truth(_over_sketches(packets, max(1, n), config, restricted), packets, config)
    flows = flow_table(packets, config)
    return _with_truth(_over_partitions(flows, flatten(build_sketch(packets, config), config), most, config, restricted), packets, config, flows)


def _over_partitions(flows: DataFrame, y: DataFrame, most: int | None, config: SketchConfig, restricted: bool) -> DataFrame:
    """A job a step finds each partition's best flow, and the driver the best of those.

    What travels is a residual of fixed size to the tasks and a row a partition back; a job's
    start costs more than the driver's whole loop for few flows. restricted as for omp.
    """
    from pyspark import StorageLevel

    spark = flows.sparkSession
    ship(spark)
    flows = flows.select("flow_id", "key", "idx").persist(StorageLevel.MEMORY_AND_DISK_2)
    solver, support = Solver(_dense(y.toPandas(), config), config), []

    def best(near: np.ndarray | None):
        """The best flow, of those at the counters `near` where it is given."""
        sent = spark.sparkContext.broadcast((solver.r, np.array(sorted(support), np.int64), near))

        def of_part(batches: Iterator[pa.RecordBatch]):
            r, taken, heavy = sent.value
            top = None
            for b in batches:
                ids = b.column(0).to_numpy()
                idx = b.column(1).flatten().to_numpy().astype(np.int64).reshape(len(ids), config.rows) + np.arange(config.rows) * config.columns
                corr, free = r[idx].sum(axis=1), ~np.isin(ids, taken)
                if heavy is not None:
                    free &= np.isin(idx, heavy).any(axis=1)
                i = _pick(corr, free, config)
                if i >= 0 and (top is None or (abs(corr[i]), -ids[i]) > (abs(top[1]), -top[0])):
                    top = (int(ids[i]), float(corr[i]), idx[i].tolist())
            rows = [top] if top else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.float64()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))], names=["flow_id", "corr", "pos"])

        parts = flows.select("flow_id", "idx").mapInArrow(of_part, "flow_id bigint, corr double, pos array<bigint>")
        found = parts.agg(F.max(F.struct(F.abs("corr").alias("a"), (-F.col("flow_id")).alias("f"), "pos")).alias("top")).first()["top"]
        sent.unpersist()
        return found

    try:
        for step in range(flows.count() if most is None else most):
            found = best(heavy_positions(solver.r, config)) if restricted and step % config.full_scan_every else None
            found = found or best(None)
            if found is None:
                break
            support.append(-found["f"])
            if not solver.add(np.array(found["pos"], np.int64)) or solver.norm() < config.least_residual:
                break
    finally:
        flows.unpersist()
    x = np.zeros(len(support))
    x[: len(solver.x)] = solver.x
    known = spark.createDataFrame([(int(f), float(v)) for f, v in zip(support, x)], "flow_id bigint, sx double")  # a row a step
    return flows.join(known, "flow_id", "left").select("flow_id", "key", F.coalesce("sx", F.lit(0.0)).alias("x"), F.col("sx").isNotNull().alias("selected"))
