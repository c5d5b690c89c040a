"""Packet streams (seq, key, weight) from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def as_event_packets(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), cents("value").alias("weight"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_packets(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), cents("o_totalprice").alias("weight"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets without a sequence, for operators that need no order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("bigint").alias("weight"))
