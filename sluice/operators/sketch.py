"""The data plane: Count-Min sketch and partitioned Bloom filter of a packet stream.

Packets are exploded to one row a hash and summed or reduced before they are shuffled
(partial aggregation), so that what moves is bounded by the sketch's size a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.config import DEFAULT, SketchConfig
from sluice.functions.hashing import with_bloom_columns, with_cms_columns


def cms_cells(df: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """df's columns with row and col for each row of the sketch."""
    rows = with_cms_columns(df, config=config, name="__idx")
    return rows.select(*df.columns, F.posexplode("__idx").alias("row", "col"))


def bloom_cells(df: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """df's columns with i and col for each hash of the Bloom filter."""
    rows = with_bloom_columns(df, config=config, name="__cells")
    return rows.select(*df.columns, F.posexplode("__cells").alias("i", "col"))


def build_sketch(packets: DataFrame, config: SketchConfig = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """row, col, value (and the columns of `by`): counters that wrap at the modulus. Cells without packets have no row; a null key counts nowhere, a null weight as 0."""
    cells = cms_cells(packets.select(*by, "key", "weight").filter("key IS NOT NULL"), config)
    return cells.groupBy(*by, "row", "col").agg((F.coalesce(F.sum("weight"), F.lit(0)) % config.counter_modulus).alias("value"))


def merge_sketches(sketches: DataFrame, config: SketchConfig = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """One sketch from several of the same shape: counters add up."""
    return sketches.groupBy(*by, "row", "col").agg((F.sum("value") % config.counter_modulus).alias("value"))


def row_totals(sketch: DataFrame) -> DataFrame:
    return sketch.groupBy("row").agg(F.sum("value").alias("total"))


def flatten(sketch: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """pos, value (double): the measurements y, without their zeros."""
    return sketch.select((F.col("row") * config.columns + F.col("col")).cast("int").alias("pos"), F.col("value").cast("double").alias("value"))


def flatten_dense(sketch: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """y with a row for every counter."""
    grid = sketch.sparkSession.range(config.counters).select(F.col("id").cast("int").alias("pos"))
    return grid.join(flatten(sketch, config), "pos", "left").select("pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def bloom_bits(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """i, col of each set bit; a null key sets none."""
    return bloom_cells(packets.select("key").filter("key IS NOT NULL"), config).select("i", "col").distinct()


def first_hits(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """i, col, first: the earliest packet that sets each bit; a null key sets none."""
    return bloom_cells(packets.select("seq", "key").filter("key IS NOT NULL"), config).groupBy("i", "col").agg(F.min("seq").alias("first"))


def new_flow_flags(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """seq, key, is_new of each packet, as a filter that is asked and filled in order of seq says.

    A key that is found sets no bit, so the filter holds the bits of all earlier packets, and a
    packet is new if it is the first on one of its cells. There are as many cells as the filter
    has bits at most (a packet with a null key is never new), so the earliest packets are a table of fixed size; those that are new at
    all are among them, and join the packets by seq.
    """
    new = first_hits(packets, config).select(F.col("first").alias("seq")).distinct().withColumn("is_new", F.lit(True))
    # at most len(bloom_seeds) * bloom_columns rows
    return packets.select("seq", "key").join(F.broadcast(new), "seq", "left").select("seq", "key", F.coalesce("is_new", F.lit(False)).alias("is_new"))


def run_stats(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """processed, new_flows, cms_total, bloom_ones: one row."""
    first = first_hits(packets, config)
    bits = first.agg(F.count("*").alias("bloom_ones"), F.count_distinct("first").alias("new_flows"))
    total = build_sketch(packets, config).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("cms_total"))
    count = packets.agg(F.count("*").alias("processed"))
    one = F.lit(1).alias("one")
    rows = count.select(one, "*").join(total.select(one, "*"), "one").join(bits.select(one, "*"), "one")
    return rows.select("processed", "new_flows", "cms_total", "bloom_ones")


def dump(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """kind (cms or bloom), row, col, value: every cell that isn't zero of both structures."""
    cms = build_sketch(packets, config).filter("value <> 0").select(F.lit("cms").alias("kind"), "row", "col", "value")
    bits = bloom_bits(packets, config).select(F.lit("bloom").alias("kind"), F.col("i").alias("row"), "col", F.lit(1).cast("bigint").alias("value"))
    return cms.unionByName(bits)


def point_estimates(keys: DataFrame, sketch: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """key, estimate: the least of a key's counters (an extension, for comparison with the recovery)."""
    cells = cms_cells(keys.select("key").distinct(), config)
    return cells.join(sketch, ["row", "col"], "left").groupBy("key").agg(F.min(F.coalesce("value", F.lit(0))).alias("estimate"))
