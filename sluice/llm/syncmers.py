"""Document fingerprints by closed syncmers.

A text's tokens are its words; of a word of over TOKEN_CHARS code points (as in scripts without
spaces) each code point is one. A k-mer is K tokens in a row; of its substrings of S tokens,
each hashed, the least must lie at one of the k-mer's two edges for the k-mer to be chosen.
Whether it is chosen depends on the k-mer alone, so equal passages choose the same anchors
wherever they stand, and two texts can be lined up by the anchors they share. The fingerprint
is the SKETCH anchors of least hash, with their places. The likeness of two estimates the
Jaccard index of the anchors, where a shared one counts if it is lined up: if its place moves
from the one text to the other as far as that of a shared anchor beside it.

Only DataFrame operations run here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import text_or_empty

K, S, TOKEN_CHARS, SKETCH = 4, 2, 12, 64

#: Rows of a range of keys, about, in which neighbours are looked for; ranges at most.
RANGE_ROWS, MOST_RANGES = 1000, 1 << 16


def _bound(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    in_word = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(text, F.lit(f"(?<!{in_word}){in_word}{{1,{TOKEN_CHARS}}}(?!{in_word})|{in_word}"), F.lit(0))


def _smers(words: Column) -> Column:
    """Hash of each two tokens in a row."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _bound(hashed, lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))


def _chosen(smers: Column, choose) -> Column:
    """choose(first, last, place) for each closed syncmer: with K - S + 1 = 3 substrings, all but those whose middle is the least."""

    def at(s, a, i):
        b, c = F.get(s, i + 1), F.get(s, i + 2)
        return F.when(c.isNotNull() & ~((b < a) & (b < c)), choose(a, c, i))

    return _bound(smers, lambda s: F.array_compact(F.transform(s, lambda a, i: at(s, a, i))))


def anchors(text: Column) -> Column:
    """array<bigint>: a text's anchors in order, the hash (31 bits) above the number of its first token."""
    return _chosen(_smers(tokens(text)), lambda a, c, i: _anchor(F.xxhash64(a, c), i))


def _anchor(h: Column, place: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32).bitwiseOR(place.cast("long"))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def sketch(text: Column) -> Column:
    """array<bigint>: the SKETCH anchors of least hash, each with its first place.

    A text of fewer than K tokens has one anchor, all its tokens; one without tokens, or a null
    one, has none.
    """
    none = F.array().cast("array<bigint>")

    def of(words):
        short = F.when(F.size(words) == 0, none).otherwise(F.array(_anchor(F.xxhash64(F.array_join(words, " ")), F.lit(0))))
        many = _chosen(_smers(words), lambda a, c, i: _anchor(F.xxhash64(a, c), i))
        firsts = _bound(F.sort_array(many), lambda x: F.filter(x, lambda a, i: (i == 0) | (hash_of(a) != hash_of(F.get(x, i - 1)))))
        return F.when(F.size(words) < K, short).otherwise(F.slice(firsts, 1, SKETCH))

    return _bound(tokens(F.coalesce(text, F.lit(""))), of)


def written(fingerprint: Column) -> Column:
    """A sketch as text, sixteen hex digits an anchor: eight of hash, eight of place."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _pairs(a: Column, b: Column, shared: Column) -> Column:
    # both are in the order of their hashes, which are distinct, so what is shared stands in one order
    mine, other = (F.filter(x, lambda y: F.array_contains(shared, hash_of(y))) for x in (a, b))
    return F.sort_array(F.zip_with(mine, other, lambda x, y: F.struct(place_of(x).alias("place"), (place_of(y) - place_of(x)).alias("move"))))


def matches(a: Column, b: Column) -> Column:
    """array<struct<place, move>> by place: the anchors that two sketches share, and how far each moves from a to b."""
    both = F.struct(a.alias("a"), b.alias("b"), F.array_intersect(F.transform(a, hash_of), F.transform(b, hash_of)).alias("shared"))
    return _bound(both, lambda x: _pairs(x["a"], x["b"], x["shared"]))


def lined_up(pairs: Column) -> Column:
    """How many shared anchors move as far as the one before or after them; a single one does."""
    return _bound(pairs, lambda m: F.when(F.size(m) < 2, F.size(m)).otherwise(F.size(F.filter(m, lambda x, i: (x["move"] == F.get(m, i + 1)["move"]) | ((i > 0) & (x["move"] == F.get(m, F.greatest(i - 1, F.lit(0)))["move"]))))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the SKETCH least hashes of both texts the share that both have, lined up; of two empty fingerprints 1."""

    def within(x):
        """With the SKETCH least hashes of both."""
        least = F.slice(F.sort_array(F.array_union(x["p"], x["q"])), 1, SKETCH)
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), F.size(least).alias("n"), F.array_intersect(F.array_intersect(x["p"], x["q"]), least).alias("shared"))

    def share(x):
        return F.when(x["n"] == 0, 1.0).when(F.size(x["shared"]) == 0, 0.0).otherwise(lined_up(_pairs(x["a"], x["b"], x["shared"])) / x["n"])

    both = F.struct(a.alias("a"), b.alias("b"), F.transform(a, hash_of).alias("p"), F.transform(b, hash_of).alias("q"))
    return _bound(_bound(both, within), share).cast("double")


def ranges(df: DataFrame, key: str, rows: int = RANGE_ROWS) -> list[int]:
    """Largest keys of ranges of about so many rows: MOST_RANGES numbers at most."""
    n, top = df.agg(F.count(key), F.max(key)).first()
    if not n:
        return []
    count = min(MOST_RANGES, -(-n // rows))
    found = df.agg(F.percentile_approx(key, [i / count for i in range(1, count)], max(10_000, 10 * count))).first()[0] if count > 1 else []
    return sorted({*found, top})


def range_of(key: Column, tops: list[int]) -> tuple[Column, Column]:
    """A key's range, and whether it is the range's largest key; looked up in two steps of about sqrt(ranges)."""
    step = max(1, round(len(tops) ** 0.5))
    leaves = [tops[i : i + step] for i in range(0, len(tops), step)]
    roots = F.from_json(F.lit(json.dumps([x[-1] for x in leaves])), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps(leaves)), "array<array<bigint>>")
    root = F.size(F.filter(roots, lambda t: t < key))
    leaf = F.coalesce(F.get(parts, root), F.array().cast("array<bigint>"))
    return (root * step + F.size(F.filter(leaf, lambda t: t < key))).cast("int"), F.array_contains(leaf, key)


def with_next(df: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """df (key and carry) with next_<column> of each carried column, of the next row by descending key; after the last comes the first.

    Keys are dealt into ranges whose largest keys are known, and the row with a range's largest
    key is sent to the range above as well, where it ends the order; so no task sees more than a
    range. Null keys come last; of repeated keys those with the least hash of what they carry
    come first; a table of one row is its own next.
    """
    tops = ranges(df, key)
    k = F.col(key)
    own, ends = range_of(k, tops)
    rows = df.withColumn("__range", F.when(k.isNull() | F.lit(not tops), F.lit(0)).otherwise(own))
    above = F.when(F.col("__range") == len(tops) - 1, 0).otherwise(F.col("__range") + 1)
    if not tops:  # no keys at all: one range, its first row ends it
        ends, above = F.lit(True), F.lit(0)
    places = F.when(ends, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("copy")), F.struct(above.cast("int").alias("r"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("copy"))))
    rows = rows.withColumn("__place", F.explode(places)).select(*df.columns, F.col("__place.r").alias("__range"), F.col("__place.copy").alias("__copy"))
    order = Window.partitionBy("__range").orderBy("__copy", k.desc_nulls_last(), F.xxhash64(*carry))
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return rows.filter("__copy = 0").drop("__range", "__copy")


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_chars, the text edited at its end with the next row's beginning, both fingerprints and the next row's.

    Columns: key, n_chars, edited (text), fingerprint, edited_fingerprint, next_fingerprint
    (sketches). A null text is empty; repeated rows give a row each; texts of any length are read
    whole; an empty table gives no rows; other columns are not carried.
    """
    rows = df.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    rows = with_next(rows.withColumn("f", sketch(F.col("t"))), "k", ["t", "f"])
    n = F.length("t").cast("long")
    cut_off = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n.cast("int") - cut_off), F.substring(F.col("next_t"), F.lit(1), cut_off))
    rows = rows.select("k", n.alias("n"), edited.alias("e"), "f", "next_f")
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_chars"), F.col("e").alias("edited"), F.col("f").alias("fingerprint"), sketch(F.col("e")).alias("edited_fingerprint"), F.col("next_f").alias("next_fingerprint"))
