"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are shares of all words by the sources' weights, none above a multiple of its
source's size. The mix is made of blocks of equally many words. Sainte-Laguë gives each
source, and within a source each shard of its documents, a whole number of blocks: seats go to
the highest quotients votes / (2 seats + 1). A shard's documents stand in a seeded order; its
blocks are full rounds over the shard and, for the rest, those from a seeded block onwards,
round the end. So a document's part follows from where its words begin in that order, without
a row for each block.

Only DataFrame operations run here. Sources and shards are summed before they are shuffled,
and a shard holds about SHARD_WORDS words, so that no source lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut, word_count

SEED = 20_24

#: Words of a shard, about; words of a block at most; blocks of an average source at least.
SHARD_WORDS, BLOCK_WORDS, SOURCE_BLOCKS = 1 << 20, 1024, 4096

#: Rounds over a source at most.
MOST_ROUNDS = 3

#: Rows of the table of sources that are broadcast at most; beyond it the table is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """parties with `quota`, the party's part of its group's `seats` (the same in all rows of the group).

    Starts from votes / (votes a seat), rounded, which is Sainte-Laguë's result for nearly as
    many seats, then gives or takes the few seats that are too few or too many by the highest
    or lowest quotients. Ties go to the smaller party. Parties without votes get none.
    """
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    rows = parties.withColumn("__sum", F.sum(v).over(of)).withColumn("__n", F.count(F.lit(1)).over(of))
    rows = rows.withColumn("__q", F.when(F.col("__sum") > 0, F.floor(v * F.col(seats) / F.col("__sum") + 0.5)).otherwise(0).cast("long"))
    rows = rows.withColumn("__need", F.when(F.col("__sum") > 0, F.col(seats) - F.sum("__q").over(of)).otherwise(0))
    # a party gains or loses no more than its share of the seats in question and of all roundings
    most = F.when(F.col("__need") == 0, 0).otherwise(F.ceil(v / F.col("__sum") * (F.abs("__need") + F.col("__n"))) + 1).cast("long")
    tries = rows.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), most)))
    after = v / (2 * (F.col("__q") + F.col("__j")) + 1)
    before = F.when(F.col("__q") > F.col("__j"), v / (2 * (F.col("__q") - F.col("__j")) - 1))
    order = F.when(F.col("__need") > 0, -after).otherwise(before)
    rank = F.row_number().over(of.orderBy(order.asc_nulls_last(), F.col(party), F.col("__j")))
    tries = tries.withColumn("__hit", (rank <= F.abs("__need")) & order.isNotNull() & (v > 0))
    keep = parties.columns
    return tries.groupBy(*keep, "__q", "__need").agg(F.sum(F.col("__hit").cast("long")).alias("__m")).select(*keep, (F.col("__q") + F.signum("__need").cast("long") * F.col("__m")).alias("quota"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: __source, __source_size. Adds __sid (rank by code point, null last), __target and __block.

    Weights are 1, 2, 3, repeating. A target stops at MOST_ROUNDS times its source's size; what
    is over goes to the others by weight until none is above: the sources whose limit is least
    for their weight are filled first.
    """
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("__sid", F.row_number().over(every.orderBy(F.col("__source").asc_nulls_last())))
    s = s.withColumn("__w", (F.pmod(F.col("__sid") - 1, F.lit(3)) + 1).cast("double")).withColumn("__cap", (MOST_ROUNDS * F.col("__source_size")).cast("double"))
    before = every.orderBy(F.col("__cap") / F.col("__w"), "__sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__source_size").over(every)
    left = total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    s = s.withColumn("__level", left / weight).withColumn("__full", F.col("__level") * F.col("__w") > F.col("__cap"))
    # levels rise while sources fill up, so that of the first that doesn't is the least of the rest's
    s = s.withColumn("__at", F.row_number().over(every.orderBy(F.col("__cap") / F.col("__w"), "__sid")))
    first = F.min(F.when(~F.col("__full"), F.struct("__at", "__level"))).over(every)
    target = F.when(first.isNull() | (F.col("__at") < first["__at"]), F.col("__cap")).otherwise(first["__level"] * F.col("__w"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(total / (SOURCE_BLOCKS * F.count(F.lit(1)).over(every))))).cast("long")
    s = s.withColumn("__target", target).withColumn("__block", block)
    s = s.withColumn("__seats", F.round(total / F.col("__block")).cast("long"))
    return s.select("__source", "__source_size", "__sid", "__target", "__block", "__seats")


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, seed: int = SEED) -> DataFrame:
    """Rows of df with __size, __source_size, __target, __rounds and two ranges of the row's words.

    The mix takes a row's words __rounds times and once more those from __from to __to and from
    __from2 to __to2 (word numbers from 0). `size` names a column of sizes; else words of `text`
    are counted (null: 0). Null sources are one source; rows without words take no part; rows
    that agree in key and size may trade places; an empty table gives no rows. Columns of df
    can't begin with two underscores (rows_of takes any names).
    """
    if clash := [c for c in df.columns if c.startswith("__")]:
        raise ValueError(f"columns of this name are made here: {clash}")
    count = F.col(size).cast("long") if size else word_count(F.col(text))
    sized = df.withColumn("__size", count).withColumn("__source", F.col(source)).withColumn("__key", F.col(key))
    if size and text not in df.columns:  # rows are small: sizes are worked out once
        sized = cut(sized)
        own = sized.select("__source", "__key", "__size")
    else:
        own = cut(sized.select("__source", "__key", "__size"))
    sources = targets(own.groupBy("__source").agg(F.sum("__size").alias("__source_size")))
    sources = sainte_lague(sources, [], "__sid", "__target", "__seats").withColumnRenamed("quota", "__source_quota").drop("__seats")
    sources = cut(sources.withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("__source_size") / SHARD_WORDS)).cast("long")).withColumnRenamed("__source", "__name"))
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    shard = F.pmod(F.xxhash64("__key", F.lit(seed)), F.col("__shards")).alias("__shard")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(sources, F.col("__source").eqNullSafe(F.col("__name"))).select(*rows.columns, "__source_size", "__sid", "__target", "__block", "__source_quota", shard)

    shards = dealt(own).groupBy("__sid", "__shard", "__source_quota", "__block").agg(F.sum("__size").alias("__shard_size"))
    shards = sainte_lague(shards, ["__sid"], "__shard", "__shard_size", "__source_quota")
    words = F.least(F.col("quota") * F.col("__block"), MOST_ROUNDS * F.col("__shard_size"))
    rounds = F.when(F.col("__shard_size") > 0, F.floor(words / F.greatest("__shard_size", F.lit(1)))).otherwise(0).cast("long")
    shards = shards.withColumn("__rounds", rounds).withColumn("__rest", words - rounds * F.col("__shard_size"))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__shard_size") / F.col("__block")))
    shards = shards.withColumn("__begin", F.pmod(F.xxhash64("__sid", "__shard", F.lit(seed)), blocks) * F.col("__block"))
    shards = shards.select("__sid", "__shard", "__shard_size", "__rounds", "__rest", "__begin")
    rows = dealt(sized)
    rows = rows.join(shards, ["__sid", "__shard"])
    order = Window.partitionBy("__sid", "__shard").orderBy(F.xxhash64("__key", F.lit(seed + 1)), "__key", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__end", F.sum("__size").over(order)).withColumn("__start", F.col("__end") - F.col("__size"))
    s, e, b, n = F.col("__start"), F.col("__end"), F.col("__begin"), F.col("__shard_size")
    stop, wrapped, zero = F.least(b + F.col("__rest"), n), F.greatest(F.lit(0).cast("long"), b + F.col("__rest") - n), F.lit(0).cast("long")
    part, part2 = _overlap(s, e, b, stop), _overlap(s, e, zero, wrapped)
    low, low2 = F.greatest(s, b) - s, F.greatest(s, zero) - s
    return rows.select(
        *df.columns, "__size", "__source_size", "__target", "__rounds",
        F.when(part > 0, low).otherwise(0).alias("__from"), F.when(part > 0, low + part).otherwise(0).alias("__to"),
        F.when(part2 > 0, low2).otherwise(0).alias("__from2"), F.when(part2 > 0, low2 + part2).otherwise(0).alias("__to2"),
    )


def taken() -> Column:
    """Words that the mix takes of a row, repeats counted."""
    return F.col("__rounds") * F.col("__size") + F.col("__to") - F.col("__from") + F.col("__to2") - F.col("__from2")


def rows_of(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: rows with df's columns, each as often as it is taken whole, and its taken part, if any, as one more.

    A part's text is its words with the white space after each but the last; n_chars, where
    there is such a column, follows the text. Columns may have any names; others than these stay
    as they are. Null and empty texts have no words and go; repeated rows count as often as they
    stand; an empty table gives no rows; texts of any length are cut at words.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return _rows_of(df.toDF(*names.values()), *(names[c] for c in (key, text, source)), names.get("n_chars"), seed).toDF(*df.columns)


def _rows_of(df: DataFrame, key: str, text: str, source: str, length: str | None, seed: int) -> DataFrame:
    mixed = mix(df, key, text, source, seed=seed)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    some = F.col("__to") - F.col("__from") + F.col("__to2") - F.col("__from2")
    part = F.concat(F.slice(words, F.col("__from2").cast("int") + 1, (F.col("__to2") - F.col("__from2")).cast("int")), F.slice(words, F.col("__from").cast("int") + 1, (F.col("__to") - F.col("__from")).cast("int")))
    part = F.regexp_replace(F.array_join(part, ""), r"[\x20\x09-\x0D]+$", "")
    texts = F.concat(F.array_repeat(F.col(text), F.col("__rounds").cast("int")), F.when((some > 0) & (some == F.col("__size")), F.array(F.col(text))).when(some > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = mixed.withColumn("__texts", texts).filter((F.size("__texts") > 0) & (F.col("__size") > 0)).withColumn("__one", F.explode("__texts"))
    kinds = {f.name: f.dataType for f in df.schema}
    return out.select(*[F.col("__one").alias(c) if c == text else F.length("__one").cast(kinds[c]).alias(c) if c == length else F.col(c) for c in df.columns])
