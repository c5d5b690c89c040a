"""Sketches of streams.

Sketches add up, so each micro-batch is summed on its own and written as a partial sketch in a
folder of its batch (a batch that runs again overwrites its own), and a reader merges them: no
state is kept but the files, and the result is exact however often a batch is tried.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import DEFAULT, SketchConfig
from sluice.operators.flows import numbered
from sluice.operators.recovery import recover_from_sketch
from sluice.operators.sketch import build_sketch, first_hits, merge_sketches


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset on one machine."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="sluice-stream-")


def run_batches(stream: DataFrame, partial, folder: str) -> None:
    """Runs the stream over what there is; partial(batch) is written to folder, a folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_a_batch).parquet(sf_dir)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_sketch(packets: DataFrame, config: SketchConfig = DEFAULT, folder: str | None = None) -> DataFrame:
    """The sketch of a stream of packets."""
    folder = folder or _folder(packets.sparkSession)
    run_batches(packets, lambda b: build_sketch(b, config), folder)
    return merge_sketches(packets.sparkSession.read.parquet(f"{folder}/parts"), config)


def stream_windowed_sketch(packets: DataFrame, ts: str, width: str, config: SketchConfig = DEFAULT, folder: str | None = None) -> DataFrame:
    """One sketch for each window of time: window_start, row, col, value."""
    folder = folder or _folder(packets.sparkSession)
    timed = packets.withColumn("window_start", F.window(ts, width)["start"])
    run_batches(timed, lambda b: build_sketch(b, config, ("window_start",)), folder)
    return merge_sketches(packets.sparkSession.read.parquet(f"{folder}/parts"), config, ("window_start",))


def stream_flow_table(packets: DataFrame, folder: str | None = None) -> DataFrame:
    """flow_id, key, true_x of a stream's flows."""
    folder = folder or _folder(packets.sparkSession)
    run_batches(packets, lambda b: b.filter("key IS NOT NULL").groupBy("key").agg(F.min("seq").alias("first"), F.sum("weight").alias("w")), folder)
    keys = packets.sparkSession.read.parquet(f"{folder}/parts").groupBy("key").agg(F.min("first").alias("first"), F.sum("w").cast("double").alias("true_x"))
    return numbered(keys, "first", "key", "flow_id").select("flow_id", "key", "true_x")


def stream_new_flows(packets: DataFrame, config: SketchConfig = DEFAULT, folder: str | None = None) -> DataFrame:
    """seq of the packets that a Bloom filter, fed in order of seq, calls new; batches may come in any order."""
    folder = folder or _folder(packets.sparkSession)
    run_batches(packets, lambda b: first_hits(b, config), folder)
    cells = packets.sparkSession.read.parquet(f"{folder}/parts").groupBy("i", "col").agg(F.min("first").alias("first"))
    return cells.select(F.col("first").alias("seq")).distinct()


def stream_new_flow_flags(packets: DataFrame, config: SketchConfig = DEFAULT, folder: str | None = None) -> DataFrame:
    """seq, key, is_new of each packet as it arrives: asked of, and put into, the filter as it then is.

    Batches follow each other; in a batch packets go by seq. A batch knows the cells that those
    before it have set (a table of the filter's size) and writes its own; one that runs again
    reads and overwrites the same.
    """
    spark, folder = packets.sparkSession, folder or _folder(packets.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        hits = first_hits(batch, config)
        if number:
            before = spark.read.parquet(f"{folder}/cells").filter(F.col("batch") < number)
            hits = hits.join(F.broadcast(before.select("i", "col")), ["i", "col"], "left_anti")  # the filter's bits at most
        hits.write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")
        new = spark.read.schema(hits.schema).parquet(f"{folder}/cells/batch={number}").select(F.col("first").alias("seq")).distinct().withColumn("is_new", F.lit(True))
        flags = batch.select("seq", "key").join(F.broadcast(new), "seq", "left")
        flags.select("seq", "key", F.coalesce("is_new", F.lit(False)).alias("is_new")).write.mode("overwrite").parquet(f"{folder}/flags/batch={number}")

    packets.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/flags").select("seq", "key", "is_new")


def stream_recovery(packets: DataFrame, most: int | None = None, config: SketchConfig = DEFAULT, folder: str | None = None, restricted: bool = False) -> DataFrame:
    """At the end of a stream's run: flow_id, key, x, selected from its counters and its keys.

    One pass writes each batch's partial sketch and its keys; no packet is kept.
    """
    spark, folder = packets.sparkSession, folder or _folder(packets.sparkSession)

    def partial(batch: DataFrame) -> DataFrame:
        cells = build_sketch(batch, config).withColumns({"key": F.lit(None).cast("bigint"), "seq": F.lit(None).cast("bigint")})
        keys = batch.filter("key IS NOT NULL").groupBy("key").agg(F.min("seq").alias("seq"))
        return cells.unionByName(keys, allowMissingColumns=True)

    run_batches(packets, partial, folder)
    parts = spark.read.parquet(f"{folder}/parts")
    sketch = merge_sketches(parts.filter("key IS NULL").select("row", "col", "value"), config)
    return recover_from_sketch(sketch, parts.filter("key IS NOT NULL").select("key", "seq"), most, config, restricted)


def live_sketch(packets: DataFrame, config: SketchConfig = DEFAULT) -> DataFrame:
    """A streaming DataFrame of counters, for update or complete mode: the state store holds the sketch, of fixed size."""
    return build_sketch(packets, config)
