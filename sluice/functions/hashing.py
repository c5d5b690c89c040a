"""64-bit mixing hash of keys as JVM expressions."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import DEFAULT, MIX, SketchConfig


def signed(x: int) -> int:
    """The 64-bit pattern as Spark's bigint."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


@contextmanager
def wrapping(spark: SparkSession):
    """Arithmetic that is analysed inside wraps at 64 bits instead of raising; the mode stays with the plan."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def mix64(x: Column) -> Column:
    """Only to be analysed under wrapping()."""
    for m in MIX:
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 33)) * F.lit(signed(m))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def _hash(key: Column, seed: int, columns: int) -> Column:
    return mix64(key.bitwiseXOR(F.lit(signed(seed)))).bitwiseAND(F.lit(columns - 1)).cast("int")


def with_mix64(df: DataFrame, key: str = "key", name: str = "hash") -> DataFrame:
    with wrapping(df.sparkSession):
        return df.withColumn(name, mix64(F.col(key)))


def with_cms_columns(df: DataFrame, key: str = "key", name: str = "idx", config: SketchConfig = DEFAULT) -> DataFrame:
    """Adds the key's column in each row of the sketch, array<int>."""
    with wrapping(df.sparkSession):
        return df.withColumn(name, F.array(*[_hash(F.col(key), s, config.columns) for s in config.cms_seeds[: config.rows]]))


def with_bloom_columns(df: DataFrame, key: str = "key", name: str = "cells", config: SketchConfig = DEFAULT) -> DataFrame:
    """Adds the key's cell in each partition of the Bloom filter, array<int>."""
    with wrapping(df.sparkSession):
        return df.withColumn(name, F.array(*[_hash(F.col(key), s, config.bloom_columns) for s in config.bloom_seeds]))


def unsigned_text(key: Column) -> Column:
    """A key as the decimal text of its unsigned value."""
    return F.conv(F.hex(key), 16, 10)
