"""Traffic generators: seeded, row by row, the same for any partitioning.

Each random number is a few steps of a multiplicative congruential generator on the row's
number, written in SQL that other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIME = 2147483647

#: The ranges of the five distributions.
MICE, ELEPHANTS, SMALL, LARGE = (1, 100), (10_000, 100_000), (1, 10), (10_000, 50_000)
ZIPF_RANKS, ZIPF_ALPHA, ZIPF_MOST = 10_000, 1.2, 100_000

DISTRIBUTIONS = ("uniform", "zipf", "heavy_elephant", "heavy_mice", "bimodal")

#: Buckets of the range lookup of a Zipf rank.
LOOKUP = 1024


def random_sql(row: str, seed: int, stream: int) -> str:
    """SQL for a number from 1 to PRIME - 1 that depends on row, seed and stream."""
    x = f"(({row} + 1) * 48271 + {seed % 65_521} * 69621 + {stream} * 16807) % {PRIME}"
    for m in (69_621, 39_373, 48_271):
        x = f"((({x}) + {m}) * {m}) % {PRIME}"
    return f"({x})"


def between_sql(low: int, high: int, row: str, seed: int, stream: int) -> str:
    return f"({low} + {random_sql(row, seed, stream)} % {high - low + 1})"


def weight_sql(distribution: str, n: int, seed: int, row: str = "id") -> str:
    """SQL for a row's weight; Zipf weights come from a lookup instead."""
    mice, elephants = between_sql(*MICE, row, seed, 1), between_sql(*ELEPHANTS, row, seed, 2)
    if distribution == "uniform":
        return mice
    if distribution == "heavy_elephant":
        return f"CASE WHEN {row} < {max(1, n // 10)} THEN {elephants} ELSE {mice} END"
    if distribution == "heavy_mice":
        return f"CASE WHEN {row} < {n * 9 // 10} THEN {mice} ELSE {elephants} END"
    if distribution == "bimodal":
        return f"CASE WHEN {random_sql(row, seed, 3)} % 2 = 0 THEN {between_sql(*SMALL, row, seed, 4)} ELSE {between_sql(*LARGE, row, seed, 5)} END"
    raise ValueError(f"unknown distribution {distribution!r}; known: {', '.join(DISTRIBUTIONS)}")


def zipf_cdf(spark: SparkSession) -> DataFrame:
    """rank, low, high: the part of the unit interval that draws each rank (low < u <= high)."""
    ranks = spark.range(1, ZIPF_RANKS + 1, numPartitions=1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-ZIPF_ALPHA)).alias("p"))
    upto = Window.orderBy("rank")
    sums = ranks.select("rank", F.sum("p").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("p").over(Window.partitionBy()).alias("total"))
    high = F.when(F.col("rank") == ZIPF_RANKS, 1.0).otherwise(F.col("upto") / F.col("total"))
    return sums.select("rank", high.alias("high")).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))


def zipf_weight(rank):
    """What a rank weighs."""
    return F.floor(F.least(F.greatest(ZIPF_MOST / F.pow(rank.cast("double"), F.lit(ZIPF_ALPHA)), F.lit(1.0)), F.lit(float(ZIPF_MOST)))).cast("bigint")


def _zipf(rows: DataFrame, seed: int) -> DataFrame:
    """Ranks by an equi-join on buckets of the unit interval (the table has ZIPF_RANKS rows)."""
    cdf = zipf_cdf(rows.sparkSession)
    cells = cdf.select("*", F.explode(F.sequence(F.floor(F.col("low") * LOOKUP), F.floor(F.col("high") * LOOKUP))).alias("cell"))
    u = rows.withColumn("u", F.expr(random_sql("id", seed, 6)) / F.lit(float(PRIME)))
    u = u.withColumn("cell", F.floor(F.col("u") * LOOKUP))
    hit = u.join(F.broadcast(cells), "cell").filter("u > low AND u <= high")
    return hit.select("id", zipf_weight(F.col("rank")).alias("weight"))


def weights(spark: SparkSession, distribution: str, n: int, seed: int = 12345) -> DataFrame:
    """id (0 to n - 1) and weight."""
    rows = spark.range(n)
    if distribution == "zipf":
        return _zipf(rows, seed)
    return rows.select("id", F.expr(weight_sql(distribution, n, seed)).cast("bigint").alias("weight"))


def key_sql(seed: int, row: str = "id") -> tuple[str, str, str]:
    """SQL for the three random parts of a 64-bit key."""
    return tuple(random_sql(row, seed, s) for s in (7, 8, 9))


def packets(spark: SparkSession, distribution: str, n: int, seed: int = 12345) -> DataFrame:
    """seq, key, weight: n packets with keys of their own, all 64 bits used."""
    a, b, c = (F.expr(x).cast("bigint") for x in key_sql(seed))
    key = F.shiftleft(a.bitwiseAND(0xFFFF), 48).bitwiseXOR(F.shiftleft(b, 16)).bitwiseXOR(c.bitwiseAND(0xFFFF))
    return weights(spark, distribution, n, seed).select(F.col("id").alias("seq"), key.alias("key"), "weight")


def cached(spark: SparkSession, folder: str, distribution: str, n: int, seed: int = 12345) -> DataFrame:
    """The same packets from Parquet in folder, written there the first time."""
    path = f"{folder}/distribution={distribution}/n={n}/seed={seed}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        packets(spark, distribution, n, seed).write.mode("overwrite").parquet(path)
    return spark.read.schema("seq bigint, key bigint, weight bigint").parquet(path)
