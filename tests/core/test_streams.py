from pyspark.sql import functions as F

from sluice.operators.flows import flow_table
from sluice.operators.sketch import build_sketch, new_flow_flags
from sluice.streaming import streams

PACKETS = "seq bigint, key bigint, weight bigint"


def source(spark, tmp_path):
    rows = [(i, i * i % 37, i % 11) for i in range(400)]
    for k in range(4):  # four files, so four batches
        spark.createDataFrame(rows[k::4], PACKETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, spark.createDataFrame(rows, PACKETS)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_stream_equals_batch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    assert same(streams.stream_sketch(stream, folder=str(tmp_path / "a")), build_sketch(batch))
    assert len(list((tmp_path / "a" / "parts").glob("batch=*"))) == 4
    assert same(streams.stream_flow_table(stream, folder=str(tmp_path / "b")), flow_table(batch).select("flow_id", "key", "true_x"))
    assert same(streams.stream_new_flows(stream, folder=str(tmp_path / "c")), new_flow_flags(batch).filter("is_new").select("seq"))


def test_flags_as_packets_arrive(spark, tmp_path):
    """Batch after batch against a filter that is asked and filled packet by packet."""
    from sluice.operators.sketch import bloom_cells

    stream, batch = source(spark, tmp_path)
    got = {r.seq: r.is_new for r in streams.stream_new_flow_flags(stream, folder=str(tmp_path / "a")).collect()}
    cells = {}
    for r in bloom_cells(batch.select("key").distinct()).collect():
        cells.setdefault(r.key, set()).add((r.i, r.col))
    key = {r.seq: r.key for r in batch.collect()}
    order = [r.seq for r in spark.read.parquet(str(tmp_path / "a" / "flags")).orderBy("batch", "seq").collect()]
    seen, want = set(), {}
    for seq in order:
        want[seq] = not cells[key[seq]] <= seen
        seen |= cells[key[seq]]
    assert got == want and len(got) == 400


def test_recovery_at_the_end(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    got = {r.key: round(r.x, 6) for r in streams.stream_recovery(stream, folder=str(tmp_path / "a")).collect()}
    assert got == {r.key: float(r.w or 0) for r in batch.groupBy("key").agg(F.sum("weight").alias("w")).collect()}


def test_live_sketch(spark, tmp_path):
    stream, batch = source(spark, tmp_path)
    q = streams.live_sketch(stream).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert same(spark.table("live"), build_sketch(batch))
