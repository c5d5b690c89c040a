"""The recovery's steps as relations: each is a composable DataFrame operator.

y and r: pos, value. support: flow_id, x. The residual and the measurements have a row a
counter at most (a size that the sketch's shape fixes), so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.config import DEFAULT, SketchConfig


def correlate(pattern: DataFrame, r: DataFrame) -> DataFrame:
    """flow_id, corr: the sum of each flow's counters."""
    return pattern.join(F.broadcast(r), "pos", "left").groupBy("flow_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("corr"))


def best_flow(corr: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """flow_id, corr: the largest correlation in absolute value, the lowest flow of equal ones; no row at or under the tolerance."""
    top = corr.agg(F.max(F.struct(F.abs("corr").alias("a"), (-F.col("flow_id")).alias("f"), "corr")).alias("top"))
    return top.filter(F.col("top.a") > config.least_correlation).select((-F.col("top.f")).alias("flow_id"), F.col("top.corr").alias("corr"))


def best_flow_by_parts(corr: DataFrame, parts: int, config: SketchConfig = DEFAULT) -> DataFrame:
    """The same from the best of each block of flows: what partial aggregation does, laid open."""
    n = corr.agg((F.max("flow_id") + 1).alias("n"))
    blocks = corr.join(F.broadcast(n)).withColumn("part", F.least(F.floor(F.col("flow_id") / F.greatest(F.lit(1), F.floor(F.col("n") / parts))), F.lit(parts - 1)))
    best = blocks.groupBy("part").agg(F.max(F.struct(F.abs("corr").alias("a"), (-F.col("flow_id")).alias("f"), "corr")).alias("top"))
    return best_flow(best.select((-F.col("top.f")).alias("flow_id"), F.col("top.corr").alias("corr")), config)


def residual(y: DataFrame, pattern: DataFrame, support: DataFrame) -> DataFrame:
    """pos, value: y less what the support explains."""
    explained = pattern.join(F.broadcast(support), "flow_id").groupBy("pos").agg(F.sum("x").alias("sx"))
    return y.join(F.broadcast(explained), "pos", "left").select("pos", (F.col("value") - F.coalesce("sx", F.lit(0.0))).alias("value"))


def norm(r: DataFrame) -> DataFrame:
    return r.agg(F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).alias("norm"))


def gram(pattern: DataFrame, support: DataFrame) -> DataFrame:
    """p, q, overlap of all pairs of a small support, zeros as well."""
    own = pattern.join(F.broadcast(support.select("flow_id")), "flow_id")
    p, q = own.select(F.col("flow_id").alias("p"), "pos"), own.select(F.col("flow_id").alias("q"), "pos")
    met = p.join(q, "pos").groupBy("p", "q").agg(F.count("*").alias("overlap"))
    ids = support.agg(F.sort_array(F.collect_list("flow_id")).alias("ids"))  # a support is small
    pairs = ids.select(F.explode("ids").alias("p"), "ids").select("p", F.explode("ids").alias("q"))
    return pairs.join(met, ["p", "q"], "left").select("p", "q", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def delta_update(corr: DataFrame, pattern: DataFrame, change: DataFrame, least: float = 1e-10) -> DataFrame:
    """flow_id, corr after the support's coefficients change by dx: only flows that share counters with it move."""
    moved = change.filter(F.abs("dx") >= least)
    at = pattern.join(F.broadcast(moved), "flow_id").groupBy("pos").agg(F.sum("dx").alias("dx"))
    less = pattern.join(F.broadcast(at), "pos").groupBy("flow_id").agg(F.sum("dx").alias("less"))
    return corr.join(less, "flow_id", "left").select("flow_id", (F.col("corr") - F.coalesce("less", F.lit(0.0))).alias("corr"))


def top_buckets(r: DataFrame, k: int) -> DataFrame:
    """pos, value of the k largest residuals in absolute value, the lowest counters of equal ones."""
    return r.orderBy(F.abs("value").desc(), "pos").limit(k)


def heavy_buckets(r: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """pos, value: counters over a share of the largest, the heaviest of them."""
    most = r.agg((F.max(F.abs("value")) * config.heavy_share).alias("least"))
    return top_buckets(r.join(F.broadcast(most), F.abs("value") > F.col("least")).select("pos", "value"), config.heavy_buckets)


def candidates(pattern: DataFrame, heavy: DataFrame) -> DataFrame:
    """flow_id of the flows at heavy counters, none left out."""
    return pattern.join(F.broadcast(heavy.select("pos")), "pos", "left_semi").select("flow_id").distinct()


def restricted_best_flow(corr: DataFrame, some: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    return best_flow(corr.join(some, "flow_id", "left_semi"), config)
