"""The flow table: distinct keys in the order of their first packet, with true totals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.config import DEFAULT, SketchConfig
from sluice.functions.hashing import with_cms_columns


def numbered(df: DataFrame, order: str, tie: str, name: str) -> DataFrame:
    """df with a number from 0 by (order, tie), without a task that holds all rows.

    Rows are dealt into ranges of `order` by its approximate quantiles and numbered in each; a
    range begins where the ranges before it end (a table of one row a range).
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    cuts = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    rows = df.withColumn("__range", F.size(F.filter(cuts, lambda c: c < F.col(order))))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__start"))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(order, tie)))
    rows = rows.join(F.broadcast(starts), "__range")
    return rows.withColumn(name, (F.col("__start") + F.col("__rank") - 1).cast("bigint")).select(*df.columns, name)


def running(df: DataFrame, order: str, value: str, name: str, descending: bool = False) -> DataFrame:
    """df with the sum of `value` up to each row by the double `order`, and in `total` that of all rows, without a task that holds all.

    As numbered: ranges by approximate quantiles, a table of one row a range for what lies before.
    Rows of equal order fall into one range, so they are best grouped before.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    cuts = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
    at = F.size(F.filter(cuts, lambda c: c < F.col(order)))
    rows = df.withColumn("__range", -at if descending else at)
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    upto = F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))  # a row a range
    starts = sums.select("__range", (upto - F.col("__sum")).alias("__start"), F.sum("__sum").over(Window.partitionBy()).alias("total"))
    by = F.col(order).desc() if descending else F.col(order)
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__own", own).join(F.broadcast(starts), "__range")
    return rows.select(*df.columns, (F.col("__start") + F.col("__own")).alias(name), "total")


def flow_table(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """flow_id, key, idx (array<int>), true_x: candidates of the recovery are exactly the distinct keys.

    Packets with a null key make no flow, null weights count 0.
    """
    keys = packets.filter("key IS NOT NULL").groupBy("key").agg(F.min("seq").alias("first"), F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("true_x"))
    rows = numbered(keys, "first", "key", "flow_id")
    return with_cms_columns(rows, config=config).select("flow_id", "key", "idx", "true_x")


def pattern(flows: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """flow_id, row, pos: the measurement matrix in coordinate form."""
    return flows.select("flow_id", F.posexplode("idx").alias("row", "col")).select("flow_id", "row", (F.col("row") * config.columns + F.col("col")).cast("int").alias("pos"))


def inverse_index(pattern: DataFrame) -> DataFrame:
    """pos, load, flows (array<bigint>, ascending): the flows at each counter that has any."""
    return pattern.groupBy("pos").agg(F.count("*").alias("load"), F.sort_array(F.collect_list("flow_id")).alias("flows"))


def offsets(pattern: DataFrame) -> DataFrame:
    """pos, load, offset: where each counter's flows begin in a list by counter (a row a counter: of fixed size)."""
    loads = pattern.groupBy("pos").agg(F.count("*").alias("load"))
    return loads.withColumn("offset", F.sum("load").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("load"))


def overlap(pattern: DataFrame) -> DataFrame:
    """p, q (p < q), overlap: flows that share counters; other pairs overlap by 0."""
    p = pattern.select(F.col("flow_id").alias("p"), "pos")
    q = pattern.select(F.col("flow_id").alias("q"), "pos")
    return p.join(q, "pos").filter("p < q").groupBy("p", "q").agg(F.count("*").alias("overlap"))


def self_overlap(pattern: DataFrame) -> DataFrame:
    return pattern.groupBy("flow_id").agg(F.count_distinct("pos").alias("overlap"))
