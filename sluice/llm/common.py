"""What the operators share: reading tables, cutting lineage, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from sluice.cluster import ship

#: Rows and bytes that one Arrow batch hands to a Python worker at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: A word is a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict = {}


def _give_back() -> None:
    """Freed memory that the allocators keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """A mapInArrow function whose worker, which lives on, gives back a task's memory when the task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def held(owner: str, key=None, make=lambda: None):
    """What an operator keeps in a worker process from task to task; taking it lets go of any other operator's."""
    if _held.get("owner") != (owner, key):
        _held.clear()
        gc.collect()
        _give_back()
        _held.update(owner=(owner, key), value=make())
    return _held["value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill a worker (session settings), and send the workers this package."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset on one machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluice-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Shuffle files of tables that nothing holds any more go, as they do once the JVM collects those tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_plain(df: DataFrame) -> DataFrame:
    """A checkpoint that forgets the estimated size of what it was made from.

    cut() keeps the estimate, and a join's is the product of its sides': in a loop of joins it
    grows to millions of digits, and planning hangs.
    """
    done, spark = cut(df), df.sparkSession
    return ClassicFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def strings(column: pa.Array) -> list[str]:
    """A string column as a list, null as empty."""
    return [x or "" for x in column.to_pylist()]


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bits of the broadcast filter (6 MB), tasks that fill it, and the share of set bits beyond which it isn't used.
FILTER_BITS, FILTER_TASKS, FILTER_FULL = 48_000_000, 12, 0.6


class Filter:
    """64-bit values, as a Bloom filter of a fixed size."""

    HASHES = 5

    def __init__(self):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)

    def _at(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            x = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(32)
            y = (x * np.uint64(0x165667B19E3779F9) ^ x >> np.uint64(31)) | np.uint64(1)
            for j in range(self.HASHES):
                at = (x + np.uint64(j) * y) % np.uint64(FILTER_BITS)
                yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)

    def add(self, values: np.ndarray) -> None:
        for at, bit in self._at(values):
            np.bitwise_or.at(self.bits, at, bit)

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at, bit in self._at(values):
            out &= (self.bits[at] & bit) > 0
        return out


def filter_of(values: DataFrame):
    """A broadcast Filter of a column of longs; None where they are too many for it."""

    def gather(batches):
        f = Filter()
        for b in batches:
            f.add(b.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(f.bits.tobytes(), 1)], pa.binary())], names=["bits"])

    out = Filter()
    for r in values.coalesce(FILTER_TASKS).mapInArrow(tidy(gather), "bits binary").collect():  # FILTER_TASKS rows of fixed size
        out.bits |= np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    if int(np.bitwise_count(out.bits).sum(dtype=np.int64)) > FILTER_FULL * FILTER_BITS:
        return None
    return values.sparkSession.sparkContext.broadcast(out)


def passing(found):
    """Whether a long may be in a broadcast Filter."""

    @F.arrow_udf("boolean")
    def has(values: pa.Array) -> pa.Array:
        return pa.array(found.value.has(values.to_numpy(zero_copy_only=False)))

    return has
