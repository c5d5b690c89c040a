"""A corpus pipeline: toxicity, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

toxicity: a classifier chain, learnt from the table labels; toxic documents go.
near_duplicates: SimHash with pigeonring filtering finds candidates; texts whose sets of
    five-word shingles have a Jaccard index of 0.8 or more are near copies; of each group of near
    copies one stays.
repeats: bytes of 100-byte strings that also start in an earlier document, or earlier in the
    same one, are taken out of the texts; no document goes.
mixing: the sources' blocks by target weights; documents come once, several times, in part
    or not at all. Documents without words go, since they have nothing to mix.
tokens: ids by the public byte vocabulary, and what they decode to.

Null texts count as empty, null keys are kept and never compared, repeated rows are near
copies of each other, an empty table gives no rows, and further columns of documents are
carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, copies, mixing, suffixes, toxicity
from sluice.llm.common import shared_folder, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.rows_of(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the checksum of what they decode to, for each row."""
    got = bpe.encode_and_decode(docs.select("doc_id", "text"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mixing", mixture),
    ("tokens", tokens),
]

#: The stages' models and hashes are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
