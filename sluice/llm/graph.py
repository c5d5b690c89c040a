"""Connected components of a table of links, on the executors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, cut_plain, tidy

MAX_ROUNDS = 60

#: Links (counted) up to which one task solves the whole table, in place of rounds of joins.
ONE_TASK = 200_000


def _sum(df: DataFrame) -> tuple:
    """Differs for most different tables; equal ones have the same."""
    r = df.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")).alias("s")).first()
    return r["n"], r["s"]


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct rows, as many each, are equal."""
    return a.join(b, ["u", "v"], "left_anti").isEmpty()


def _solve(batches):
    """Union-find over a table of a bounded size; struct vertices are compared field by field."""
    parent, shown = {}, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    names, kind = ["u", "v"], None
    for b in batches:
        kind = b.schema
        for pair in zip(*(b.column(i).to_pylist() for i in (0, 1))):
            ends = []
            for x in pair:
                k = tuple(x.values()) if isinstance(x, dict) else x
                if k not in parent:
                    parent[k], shown[k] = k, x
                ends.append(find(k))
            parent[max(ends)] = min(ends)
    found = [(x, find(x)) for x in parent]
    found = [(shown[x], shown[r]) for x, r in found if x != r]
    for low in range(0, len(found), 50_000):
        part = found[low : low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], kind.field(i).type) for i in (0, 1)], names=names)


def components(links: DataFrame) -> DataFrame:
    """u, v -> each vertex u that isn't its component's least, with that least vertex v.

    Up to ONE_TASK distinct links are solved in one task. Beyond, no task sees more than a share:
    two steps alternate until nothing changes: every vertex sends its larger neighbours, then
    its smaller ones, to the least it knows, so that components become stars in a number of
    rounds that grows with the logarithm of their size. Each round is checkpointed. u and v can
    be of any ordered type; loops and repeated links do no harm; no links give no rows.
    """
    big, small = F.when(F.col("u") > F.col("v"), F.col("u")).otherwise(F.col("v")), F.when(F.col("u") > F.col("v"), F.col("v")).otherwise(F.col("u"))
    now = cut_plain(links.filter("u != v").select(big.alias("u"), small.alias("v")).distinct())
    seen = _sum(now)
    if seen[0] <= ONE_TASK:
        bounded_batches(now.sparkSession)
        return cut_plain(now.coalesce(1).mapInArrow(tidy(_solve), now.schema)) if seen[0] else now
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        both = now.union(now.select("v", "u"))
        # each vertex's least is cut off, so that its join stands alone and Spark can split a star's centre
        least = cut_plain(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m")))
        large = cut_plain(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut_plain(large.groupBy("u").agg(F.min("v").alias("m")))
        stars = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut_plain(stars.union(least.select("u", F.col("m").alias("v"))).distinct())
        found = _sum(now)
        if found == seen and _same(now, before):
            return now
        seen = found
    if seen[0]:
        raise RuntimeError("components did not settle")
    return now
