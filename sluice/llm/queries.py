"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.llm import bpe, langid, mixing, simhash, suffixes, syncmers, tokenfile, toxicity, transport, urls
from sluice.llm.common import table, text_or_empty, word_count

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_transport_streams(spark, sf_dir):
    """Every text as samples in a transport stream, written, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("t"))
    n = F.octet_length("t").cast("long")
    pad = F.when(n == 0, 192).otherwise(F.pmod(-n, F.lit(192)))
    rows = docs.select("doc_id", n.alias("n_bytes"), F.concat("t", F.repeat(F.lit(" "), pad.cast("int"))).cast("binary").alias("samples"))
    media = transport.write(rows, carry=("n_bytes",))
    media = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = transport.read(media, carry=("n_bytes", "media_bytes", "media_sha256"))
    feature = F.concat_ws(
        ";",
        F.format_string("program=%d,pid=%d,type=%d,packets=%d,gaps=%d", "program", "pid", "stream_type", "packets", "gaps"),
        F.format_string("units=%d,entries=%d,pts=%d-%d", F.size("units"), F.size(F.filter("units", lambda u: u["random_access"])), F.get("units.pts", F.lit(0)), F.get("units.pts", F.size("units") - 1)),
        F.format_string("level=%.6f,rms=%.6f", "level", "rms"),
    )
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


@query
def op10_byte_bpe(spark, sf_dir):
    """Every text's ids by the public byte vocabulary, and what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.encode_and_decode(docs)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def op9_url_rules(spark, sf_dir):
    """Every page's url judged by four rules, through cascades over the urls' keys."""
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, action string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES["op9_url_rules"] = r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), t AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM t
"""


@query
def op3_language(spark, sf_dir):
    """Every text's language by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held)
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model, carry=("held_out",))


@query
def op5_toxicity(spark, sf_dir):
    """Every text's probabilities by the chain that learns from `labels`."""
    return toxicity.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query
def op1_simhash(spark, sf_dir):
    """Every text's 64-bit fingerprint, and the least doc_id over links of 4 bits or fewer."""
    got = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, lanes=1, most=4)
    return got.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_mixing(spark, sf_dir):
    """Words that a mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, size="size")
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), mixing.taken().alias("taken"))


@query
def op4_syncmers(spark, sf_dir):
    """Every text's fingerprint against that of its edited text and of the next document."""
    got = syncmers.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    got = got.withColumns({f"near_{x}": syncmers.likeness(F.col("fingerprint"), F.col(f"{x}_fingerprint")) for x in ("edited", "next")})
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.written(F.col("fingerprint")).alias("fingerprint"),
        syncmers.written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op8_repeats(spark, sf_dir):
    """Every text without the bytes of 100-byte strings that also start earlier."""
    got = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select(
        "doc_id",
        (F.octet_length("__kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


ORACLES["op8_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS p FROM n)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE r > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
runs AS (SELECT doc_id, k, min(p) AS s, max(p) + 100 AS e FROM i GROUP BY doc_id, k),
edges AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM runs),
ends AS (SELECT n.doc_id, n.n, coalesce(max(e), 0) AS b, count(e) AS n_spans, coalesce(sum(e - s), 0) AS n_removed FROM n LEFT JOIN runs USING (doc_id) GROUP BY n.doc_id, n.n),
parts AS (SELECT doc_id, s AS o, substr(h, 2 * b + 1, 2 * (s - b)) AS part FROM edges JOIN n USING (doc_id)
  UNION ALL SELECT doc_id, ends.n + 1 AS o, substr(h, 2 * b + 1) AS part FROM ends JOIN n USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY o))) AS kept_sha256 FROM parts GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, kept_sha256 FROM ends JOIN kept USING (doc_id)
"""


@query
def op6_token_ids(spark, sf_dir):
    """Every text's ids and the end id, written to files and read back."""
    got = tokenfile.store(table(spark, sf_dir, "documents").select("doc_id", "text"), end=1)
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
