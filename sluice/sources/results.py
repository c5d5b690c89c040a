"""Benchmark results: RESULT lines, CSV files, a Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "distribution string, n bigint, k int, impl string, time_ms double, stddev_ms double, throughput double"
NAMES = ("distribution", "n", "k", "impl", "time_ms", "stddev_ms", "throughput")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Results from lines `RESULT,...`; other lines, and those of under eight fields or with fields that aren't numbers, are skipped."""
    part = F.split(F.trim(F.col(column)), ",")
    rows = lines.filter(F.col(column).startswith("RESULT,") & (F.size(part) >= 8)).select(part.alias("p"))
    kinds = [x.split()[1] for x in SCHEMA.split(", ")]
    rows = rows.select(*[F.get("p", F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(zip(NAMES, kinds))])
    return rows.dropna(subset=["n", "k", "time_ms", "stddev_ms", "throughput"])


def result_line() -> Column:
    """The line of a row of results."""
    return F.format_string("RESULT,%s,%d,%d,%s,%.3f,%.3f,%.0f", *[F.col(n) for n in NAMES])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def save(results: DataFrame, path: str) -> None:
    results.select(*NAMES).write.mode("overwrite").option("header", True).csv(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("header", True).csv(path)


def report_rows(results: DataFrame) -> DataFrame:
    """line: a row of the report's table for each result."""
    cells = F.format_string("| %s | %d | %d | %s | %.3f | %.3f | %.0f |", *[F.col(n) for n in NAMES])
    return results.select(*NAMES, cells.alias("line"))


def report(results: DataFrame, configuration: dict[str, object] | None = None) -> str:
    """Markdown: the configuration, a table of all results, and the speedups of the report's subset; benchmark results are few."""
    from sluice.operators.metrics import report_speedup

    rows = report_rows(results).orderBy("distribution", "n", "k", "impl").collect()
    lines = ["# Benchmark", ""]
    if configuration:
        lines += ["## Configuration", "", *(f"- {k}: {v}" for k, v in configuration.items()), "", "## Results", ""]
    lines += ["| distribution | n | k | impl | ms | sd | flows a second |", "| --- | --- | --- | --- | --- | --- | --- |"]
    lines += [r.line for r in rows]
    lines += ["", "## Speedup", "", "| n | speedup |", "| --- | --- |"]
    lines += [f"| {r.n} | {r.speedup:.2f} |" for r in report_speedup(results).orderBy("n").collect()]
    return "\n".join(lines) + "\n"
