"""Errors of a recovery, statistics of weights, reports on benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.flows import running


def recovery_error(estimates: DataFrame) -> DataFrame:
    """Of selected flows: abs_err (signed: estimate less truth) and rel_err (0 where the truth is 0)."""
    off = F.col("x") - F.col("true_x")
    rel = F.when(F.col("true_x") != 0, F.abs(off) / F.col("true_x")).otherwise(0.0)
    return estimates.filter("selected").select("flow_id", "key", "true_x", "x", off.alias("abs_err"), rel.alias("rel_err"))


def recovery_mse(estimates: DataFrame) -> DataFrame:
    """One row: squared errors of selected flows, divided by the number of all flows."""
    off = F.col("x") - F.col("true_x")
    return estimates.agg((F.coalesce(F.sum(F.when(F.col("selected"), off * off)), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("mse"))


def weight_stats(packets: DataFrame, weight: str = "weight") -> DataFrame:
    """mean, min, max, population sd and median; zeros for no packets. Null weights are left out.

    The median is exact: the least weights that a half of the packets, and one more, don't pass.
    """
    w = F.col(weight).cast("double")
    parts = {"mean": F.avg(w), "min": F.min(w), "max": F.max(w), "stddev": F.stddev_pop(w)}
    one = packets.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in parts.items()])
    counts = packets.select(w.alias("w")).filter("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n"))
    at = running(counts, "w", "n", "upto")
    middle = [F.min(F.when(F.col("upto") >= F.floor((F.col("total") + i) / 2), F.col("w"))) for i in (1, 2)]
    return one.join(at.agg(F.coalesce((middle[0] + middle[1]) / 2, F.lit(0.0)).alias("median")))  # a row each


def weight_histogram(packets: DataFrame, bins: int = 50, weight: str = "weight") -> DataFrame:
    """bin (1 to bins), count: equal bins from least to largest weight, the last with the largest."""
    w = F.col(weight).cast("double")
    span = packets.agg(F.min(w).alias("lo"), F.max(w).alias("hi"))
    rows = packets.select(w.alias("w")).join(F.broadcast(span))
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("w") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def weight_cdf(packets: DataFrame, weight: str = "weight") -> DataFrame:
    """weight, share: the share of packets at or under each weight that occurs.

    Counts a weight first, so that only distinct weights are put in order, in ranges.
    """
    counts = packets.groupBy(F.col(weight).alias("weight")).agg(F.count("*").alias("n"))
    counts = counts.filter("weight IS NOT NULL").withColumn("w", F.col("weight").cast("double"))
    return running(counts, "w", "n", "upto").select("weight", (F.col("upto") / F.col("total")).alias("share"))


def traffic_concentration(flows: DataFrame, weight: str = "true_x", shares: tuple[int, ...] = (10, 5, 2)) -> DataFrame:
    """divisor, percent: the part of all weight in the heaviest n // divisor flows.

    Flows of equal weight are counted together, so that only distinct weights are put in order, in ranges.
    """
    counts = flows.groupBy(F.col(weight).cast("double").alias("w")).agg(F.count("*").alias("n"))
    rows = running(counts, "w", "n", "upto", descending=True)
    whole = counts.agg(F.sum(F.col("w") * F.col("n")).alias("weight"))
    rows = rows.join(F.broadcast(whole)).select("w", "n", (F.col("upto") - F.col("n")).alias("before"), F.col("total").alias("flows"), F.col("weight").alias("total"))  # one row
    rows = rows.select("*", F.explode(F.array(*[F.lit(d) for d in shares])).alias("divisor"))
    take = F.greatest(F.lit(0), F.least("n", F.floor(F.col("flows") / F.col("divisor")) - F.col("before")))
    return rows.groupBy("divisor").agg((F.sum(F.col("w") * take) * 100 / F.max("total")).alias("percent"))


def throughput_summary(runs: DataFrame) -> DataFrame:
    """Of runs (distribution, n, k, impl, time_ms): mean and population sd of the time, packets a second."""
    rows = runs.groupBy("distribution", "n", "k", "impl").agg(F.avg("time_ms").alias("time_ms"), F.stddev_pop("time_ms").alias("stddev_ms"))
    return rows.withColumn("throughput", F.col("n") / (F.col("time_ms") / 1000))


def time_by_n(results: DataFrame, distribution: str, k: int) -> DataFrame:
    """impl, n, time_ms for a plot."""
    return results.filter((F.col("distribution") == distribution) & (F.col("k") == k)).select("impl", "n", "time_ms")


def throughput_bars(results: DataFrame, n: int, k: int, impls: tuple[str, ...]) -> DataFrame:
    """distribution and a column of throughput for each implementation, 0 where there is none."""
    rows = results.filter((F.col("n") == n) & (F.col("k") == k))
    return rows.groupBy("distribution").pivot("impl", list(impls)).agg(F.first("throughput")).na.fill(0.0)


def speedup(results: DataFrame, k: int, of: str = "cpu", over: str = "gpu") -> DataFrame:
    """distribution, n, speedup: time of one implementation by that of another, 0 where one is missing."""
    rows = results.filter(F.col("k") == k).groupBy("distribution", "n").pivot("impl", [of, over]).agg(F.first("time_ms"))
    ratio = F.when((F.col(over) > 0) & F.col(of).isNotNull(), F.col(of) / F.col(over)).otherwise(0.0)
    return rows.select("distribution", "n", ratio.alias("speedup"))


def stress(results: DataFrame, least: int = 500_000, distribution: str = "zipf") -> DataFrame:
    return results.filter((F.col("n") >= least) & (F.col("distribution") == distribution))


def report_speedup(results: DataFrame) -> DataFrame:
    """n, speedup of the report's subset."""
    rows = speedup(results.filter("distribution = 'zipf' AND n IN (10000, 100000, 1000000)"), 100, "cpu", "gpu_opt")
    return rows.select("n", "speedup")
