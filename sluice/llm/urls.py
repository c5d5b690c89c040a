"""URL rules answered by cascades of Bloom filters.

A rule is a host and a path with an action. Every url offers candidate keys: each suffix of
its host at a label's border, with each prefix of its path of a length that some rule has.
For each action a cascade is built over the complete universe of candidate keys of the urls:
level 0 holds the listed keys, level 1 those other keys of the universe that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on until a level lets
nothing through. The first level that lacks a key decides, so membership is exact for every
key of the universe, and urls are judged without a join. Of very many rules the keys are dealt
into parts by a hash, each with its own cascades, which are broadcast one part after another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, cut

#: Chance that a key passes by mistake: at level 0, and at later levels.
FIRST, LATER = 1 / 64, 1 / 4

#: Bits of the levels of one part of the keys, about, that are broadcast at once (32 MB).
PART_BITS = 1 << 28

MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # bytes, eight bits each
    size: int
    hashes: int


def _shape(n: int, level: int) -> tuple[int, int]:
    p = LATER if level else FIRST
    size = max(64, -(-math.ceil(n * math.log2(1 / p) / math.log(2)) // 64) * 64)
    return size, max(1, round(math.log2(1 / p)))


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """Bit places of keys with hashes a and b (uint64), one row for each hash function."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (b + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        x ^= x >> np.uint64(31)
        y ^= y >> np.uint64(30)
        return np.stack([((x + np.uint64(j) * y) >> np.uint64(11)) % np.uint64(size) for j in range(hashes)])


def passes(levels: list[Level], number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lv = levels[number]
    at = _places(a, b, number, lv.size, lv.hashes)
    return ((lv.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def member(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe that the cascade was built over."""
    out = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for i in range(len(levels)):
        hit = passes(levels, i, a[open_], b[open_])
        out[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def _level(keys: DataFrame, n: int, number: int) -> Level:
    """A level's bits, or-ed together on the executors; the driver gets size / 64 words."""
    size, hashes = _shape(n, number)

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for x in batches:
            a, b = (x.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            at = np.unique(_places(a, b, number, size, hashes))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        words = bits.view("<i8")
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(words[full], pa.int64())], names=["at", "word"])

    rows = keys.select("a", "b").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect()
    words = np.zeros(size // 64, "<i8")
    for r in rows:
        words[r["at"]] = r["word"]
    return Level(words.view(np.uint8), size, hashes)


def _through(keys: DataFrame, levels: list[Level], number: int) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def hit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(passes(sent.value, number, a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)))

    return keys.filter(hit("a", "b"))


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels over keys (hashes a and b of each)."""
    mine = cut(listed.select("a", "b").distinct())
    n = mine.count()
    levels: list[Level] = []
    if not n:
        return levels
    other = None
    for number in range(MAX_LEVELS):
        levels.append(_level(mine, n, number))
        # what stands on the other side and passes this level goes into the next
        rest = _through(universe.select("a", "b") if other is None else other, levels, number)
        if other is None:
            rest = rest.distinct().join(mine, ["a", "b"], "left_anti")
        rest = cut(rest)
        mine, other, n = rest, mine, rest.count()
        if not n:
            return levels
    raise ValueError("two keys share both hashes: the cascade can't end")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or for one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"a": F.xxhash64(key), "b": F.xxhash64(F.lit("second"), key)})


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page key, host, path, rule and verdict of each url.

    rules: host, path, action (block or allow), paths with their leading slash. A rule fits its
    host and all subdomains where the path starts with the rule's; the longest rule wins, of
    equally long ones that with the longer host, and block before allow for the same rule. Where
    none fits, rule is null and the verdict is `otherwise`: the key is in no list. A null url has
    empty host and path. Repeated rows are judged alike; an empty table gives no rows; other
    columns are not carried.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    listed = rules.select(F.concat("host", "path").alias("rule"), "action", F.length("path").alias("n")).filter("rule IS NOT NULL").distinct()
    # lengths of rules' paths: as many as the longest path has letters at most
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(ends, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    base = base.withColumn("keys", keys)
    universe = _keyed(base.select(F.explode("keys").alias("c")), "c")
    parts = max(1, -(-listed.count() * 2 * math.ceil(math.log2(1 / FIRST)) // PART_BITS))
    base = base.withColumn("best", F.lit(None).cast(BEST))
    for part in range(parts):
        base = _judged(base, universe, listed, part, parts)
        if parts > 1:  # one part's cascades at a time
            base = cut(base)
    verdict = F.when(F.col("best.action") == 1, "block").when(F.col("best.action") == 2, "allow").otherwise(otherwise)
    return base.select(F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


#: The best rule so far, least first: the longest, of equally long ones that with the longer host.
BEST = "struct<shorter:int,at:int,rule:string,action:int>"


def _judged(base: DataFrame, universe: DataFrame, listed: DataFrame, part: int, parts: int) -> DataFrame:
    """base with the best rule also of the keys of this part."""
    filters = {}
    for action in ("block", "allow"):
        mine = _keyed(listed.filter(F.col("action") == action).select("rule"), "rule")
        filters[action] = cascade(*(x.filter(F.pmod("b", F.lit(parts)) == part) if parts > 1 else x for x in (universe, mine)))
    sent = base.sparkSession.sparkContext.broadcast(filters)  # PART_BITS about

    @F.pandas_udf("array<int>")
    def lists(a: pd.Series, b: pd.Series) -> pd.Series:
        """1 for a blocked key, 2 for an allowed one, 0 for any other."""
        sizes = np.array([len(x) for x in a])
        x, y = (np.concatenate([np.asarray(v, np.int64) for v in c] or [np.empty(0, np.int64)]).view(np.uint64) for c in (a, b))
        got = np.where(member(sent.value["block"], x, y), 1, np.where(member(sent.value["allow"], x, y), 2, 0))
        return pd.Series(np.split(got.astype(np.int32), np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

    # hosts come longest first, so of equally long keys the first has the longest host
    own = F.transform("keys", lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("at"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b")))
    own = F.filter(own, lambda x: F.pmod(x["b"], F.lit(parts)) == part) if parts > 1 else own
    judged = base.withColumn("own", own).withColumn("found", lists(F.col("own.a"), F.col("own.b")))
    fit = F.transform(F.filter(F.arrays_zip("own", "found"), lambda z: z["found"] > 0), lambda z: F.struct((-F.length(z["own"]["c"])).alias("shorter"), z["own"]["at"].alias("at"), z["own"]["c"].alias("rule"), z["found"].alias("action")))
    best = F.array_min(F.concat(F.array_compact(F.array("best")), fit))
    return judged.withColumn("best", best).drop("own", "found")
