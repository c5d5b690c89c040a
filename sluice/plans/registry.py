"""Every query of the core library and its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluice.config import DEFAULT
from sluice.functions.hashing import unsigned_text, with_mix64
from sluice.operators import flows as fl
from sluice.operators import metrics, recovery, sketch, steps
from sluice.plans.oracle import EVENTS, FLOWS, LINEITEM, ORDERS, bloom, cms, generated, pursuit, solve
from sluice.sources import generators, packets, results
from sluice.streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- hashing


@query(
    f"""WITH {cms("SELECT DISTINCT user_id AS key FROM events")}, h AS (SELECT key, x FROM (SELECT key, key::UBIGINT AS x FROM src)),
    h1 AS (SELECT key, ((xor(x, x >> 33))::UHUGEINT * 18397679294719823053::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM h),
    h2 AS (SELECT key, ((xor(x, x >> 33))::UHUGEINT * 14181476777654086739::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM h1)
    SELECT key, xor(x, x >> 33)::VARCHAR AS hash FROM h2"""
)
def mix64_hash(spark, sf_dir):
    keys = packets.events(spark, sf_dir).select("key").distinct()
    return with_mix64(keys).select("key", unsigned_text(F.col("hash")).alias("hash"))


@query(f'WITH {cms("SELECT DISTINCT user_id AS key FROM events")} SELECT key, "row", col FROM p')
def hash_positions(spark, sf_dir):
    return sketch.cms_cells(packets.events(spark, sf_dir).select("key").distinct())


@query(f"WITH {bloom('SELECT DISTINCT user_id AS key FROM events')} SELECT key, i, col FROM p8")
def bloom_positions(spark, sf_dir):
    return sketch.bloom_cells(packets.events(spark, sf_dir).select("key").distinct())


# --- sketch

_SUM = 'SELECT "row", col, (sum(weight) % 4294967296)::BIGINT AS value FROM p GROUP BY "row", col'


@query(f"WITH {cms(EVENTS)} {_SUM}")
def cms_sketch(spark, sf_dir):
    return sketch.build_sketch(packets.events(spark, sf_dir))


@query(f"WITH {cms(LINEITEM)} {_SUM}")
def cms_sketch_lineitem(spark, sf_dir):
    return sketch.build_sketch(packets.lineitem(spark, sf_dir))


@query(f"WITH {cms(ORDERS)} {_SUM}")
def cms_sketch_orders(spark, sf_dir):
    return sketch.build_sketch(packets.orders(spark, sf_dir))


@query(f'WITH {cms(EVENTS)} SELECT "row", sum(value)::BIGINT AS total FROM ({_SUM}) GROUP BY "row"')
def cms_row_totals(spark, sf_dir):
    return sketch.row_totals(sketch.build_sketch(packets.events(spark, sf_dir)))


@query(f"WITH {FLOWS} SELECT n::INTEGER AS pos, coalesce(value, 0)::DOUBLE AS value FROM range(65536) g(n) LEFT JOIN y ON y.pos = n")
def cms_flatten(spark, sf_dir):
    return sketch.flatten_dense(sketch.build_sketch(packets.events(spark, sf_dir)))


@query(f"WITH {bloom(EVENTS)} SELECT DISTINCT i, col FROM p8")
def bloom_bits(spark, sf_dir):
    return sketch.bloom_bits(packets.events(spark, sf_dir))


def _flags(source: str) -> str:
    return f"""WITH {bloom(source)}, f AS (SELECT seq, key, min(seq) OVER (PARTITION BY i, col) = seq AS own FROM p8)
    SELECT seq, key, bool_or(own) AS is_new FROM f GROUP BY seq, key"""


@query(_flags(EVENTS))
def new_flow_flags(spark, sf_dir):
    return sketch.new_flow_flags(packets.events(spark, sf_dir))


@query(_flags(ORDERS))
def new_flow_flags_orders(spark, sf_dir):
    return sketch.new_flow_flags(packets.orders(spark, sf_dir))


@query(
    f"""WITH {cms(EVENTS)}, {bloom(EVENTS)}, c AS ({_SUM}), hits AS (SELECT i, col, min(seq) AS first FROM p8 GROUP BY i, col)
    SELECT (SELECT count(*) FROM src) AS processed, (SELECT count(DISTINCT first) FROM hits) AS new_flows,
    (SELECT sum(value)::BIGINT FROM c) AS cms_total, (SELECT count(*) FROM hits) AS bloom_ones"""
)
def run_stats(spark, sf_dir):
    return sketch.run_stats(packets.events(spark, sf_dir))


@query(
    f"""WITH {cms(EVENTS)}, {bloom(EVENTS)}, c AS ({_SUM}) SELECT 'cms' AS kind, "row", col, value FROM c WHERE value <> 0
    UNION ALL SELECT DISTINCT 'bloom', i, col, 1::BIGINT FROM p8"""
)
def sketch_dump(spark, sf_dir):
    return sketch.dump(packets.events(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT key, min(value)::BIGINT AS estimate FROM pattern JOIN y USING (pos) JOIN flows USING (flow_id) GROUP BY key")
def point_estimates(spark, sf_dir):
    p = packets.events(spark, sf_dir)
    return sketch.point_estimates(p, sketch.build_sketch(p))


# --- flows


@query(f'WITH {FLOWS} SELECT flow_id, key, "row", (pos - "row" * 16384)::INTEGER AS col, true_x FROM flows JOIN pattern USING (flow_id)')
def flow_table(spark, sf_dir):
    rows = fl.flow_table(packets.events(spark, sf_dir))
    return rows.select("flow_id", "key", F.posexplode("idx").alias("row", "col"), "true_x")


@query(
    """WITH k AS (SELECT o_custkey AS key, min(o_orderkey) AS first, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS true_x FROM orders GROUP BY 1)
    SELECT row_number() OVER (ORDER BY first, key) - 1 AS flow_id, key, true_x FROM k"""
)
def flow_truth(spark, sf_dir):
    return fl.flow_table(packets.orders(spark, sf_dir)).select("flow_id", "key", "true_x")


@query(f'WITH {FLOWS} SELECT flow_id, "row", pos FROM pattern')
def pattern_matrix(spark, sf_dir):
    return fl.pattern(fl.flow_table(packets.events(spark, sf_dir)))


def _base(spark, sf_dir):
    p = packets.events(spark, sf_dir)
    return fl.pattern(fl.flow_table(p)), sketch.flatten(sketch.build_sketch(p))


@query(f"WITH {FLOWS} SELECT p.flow_id AS p, q.flow_id AS q, count(*) AS overlap FROM pattern p JOIN pattern q ON p.pos = q.pos AND p.flow_id < q.flow_id GROUP BY 1, 2")
def overlap_pairs(spark, sf_dir):
    return fl.overlap(_base(spark, sf_dir)[0])


@query(f"WITH {FLOWS} SELECT flow_id, count(DISTINCT pos) AS overlap FROM pattern GROUP BY flow_id")
def self_overlap(spark, sf_dir):
    return fl.self_overlap(_base(spark, sf_dir)[0])


@query(f"WITH {FLOWS} SELECT pos, count(*) AS load, string_agg(flow_id::VARCHAR, ',' ORDER BY flow_id) AS flows FROM pattern GROUP BY pos")
def inverse_index(spark, sf_dir):
    return fl.inverse_index(_base(spark, sf_dir)[0]).select("pos", "load", F.array_join(F.col("flows").cast("array<string>"), ",").alias("flows"))


@query(f'WITH {FLOWS}, l AS (SELECT pos, count(*) AS load FROM pattern GROUP BY pos) SELECT pos, load, (sum(load) OVER (ORDER BY pos) - load)::BIGINT AS "offset" FROM l')
def bucket_load(spark, sf_dir):
    return fl.offsets(_base(spark, sf_dir)[0])


# --- recovery, step by step


@query(f"WITH {FLOWS} SELECT flow_id, corr FROM corr")
def correlation_step0(spark, sf_dir):
    return steps.correlate(*_base(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT flow_id, corr FROM best")
def best_flow_step0(spark, sf_dir):
    return steps.best_flow(steps.correlate(*_base(spark, sf_dir)))


@query(f"WITH {FLOWS} SELECT flow_id, corr FROM best")
def partitioned_best_flow(spark, sf_dir):
    return steps.best_flow_by_parts(steps.correlate(*_base(spark, sf_dir)), 4)


def _step1(spark, sf_dir):
    pattern, y = _base(spark, sf_dir)
    corr = steps.correlate(pattern, y)
    return pattern, y, corr, steps.best_flow(corr).select("flow_id", (F.col("corr") / DEFAULT.rows).alias("x"))


@query(f"WITH {FLOWS} SELECT flow_id, x FROM step1")
def omp_step1_coeff(spark, sf_dir):
    return _step1(spark, sf_dir)[3]


@query(f"WITH {FLOWS} SELECT pos, value FROM r1")
def omp_step1_residual(spark, sf_dir):
    pattern, y, _, support = _step1(spark, sf_dir)
    return steps.residual(y, pattern, support)


@query(f"WITH {FLOWS} SELECT round(sqrt(sum(value * value)), 3) AS norm FROM r1")
def omp_step1_norm(spark, sf_dir):
    pattern, y, _, support = _step1(spark, sf_dir)
    return steps.norm(steps.residual(y, pattern, support)).select(F.round("norm", 3).alias("norm"))


@query(f"WITH {FLOWS} SELECT flow_id, sum(value) AS corr FROM pattern JOIN r1 USING (pos) GROUP BY flow_id")
def corr_delta_update(spark, sf_dir):
    pattern, _, corr, support = _step1(spark, sf_dir)
    return steps.delta_update(corr, pattern, support.withColumnRenamed("x", "dx"))


@query(
    f"""WITH {FLOWS}, s AS (SELECT flow_id FROM corr ORDER BY abs(corr) DESC, flow_id LIMIT 20), own AS (SELECT flow_id, pos FROM pattern JOIN s USING (flow_id)),
    met AS (SELECT p.flow_id AS p, q.flow_id AS q, count(*) AS n FROM own p JOIN own q USING (pos) GROUP BY 1, 2)
    SELECT a.flow_id AS p, b.flow_id AS q, coalesce(n, 0) AS overlap FROM s a CROSS JOIN s b LEFT JOIN met ON p = a.flow_id AND q = b.flow_id"""
)
def gram_matrix(spark, sf_dir):
    pattern, y = _base(spark, sf_dir)
    support = steps.correlate(pattern, y).orderBy(F.abs("corr").desc(), "flow_id").limit(20)
    return steps.gram(pattern, support)


@query(f"WITH {FLOWS} SELECT flow_id, corr AS b FROM corr ORDER BY abs(corr) DESC, flow_id LIMIT 20")
def rhs_vector(spark, sf_dir):
    return steps.correlate(*_base(spark, sf_dir)).orderBy(F.abs("corr").desc(), "flow_id").limit(20).withColumnRenamed("corr", "b")


_TOP20 = f"{FLOWS}, top AS (SELECT flow_id FROM corr ORDER BY abs(corr) DESC, flow_id LIMIT 20), none AS (SELECT flow_id, 0::DOUBLE AS x FROM top), {solve('best20', 'top', 'none')}"


def _support_solution(spark, sf_dir):
    pattern, y = _base(spark, sf_dir)
    top = steps.correlate(pattern, y).orderBy(F.abs("corr").desc(), "flow_id").limit(20)
    return recovery.solve_support(steps.gram(pattern, top), top.withColumnRenamed("corr", "b"))


@query(f"WITH {_TOP20} SELECT flow_id, round(x, 3) + 0.0 AS x FROM best20")
def support_solution(spark, sf_dir):
    """Least squares on the 20 flows that correlate best."""
    return _support_solution(spark, sf_dir).select("flow_id", (F.round("x", 3) + 0.0).alias("x"))


@query(f"WITH {_TOP20} SELECT y.pos, round(value - coalesce(sx, 0), 2) + 0.0 AS value FROM y LEFT JOIN (SELECT pos, sum(x) AS sx FROM pattern JOIN best20 USING (flow_id) GROUP BY pos) USING (pos)")
def support_residual(spark, sf_dir):
    """What those 20 flows leave of the measurements."""
    pattern, y = _base(spark, sf_dir)
    return steps.residual(y, pattern, _support_solution(spark, sf_dir)).select("pos", (F.round("value", 2) + 0.0).alias("value"))


@query(f"WITH {FLOWS} SELECT pos, value FROM heavy")
def heavy_buckets(spark, sf_dir):
    return steps.heavy_buckets(_base(spark, sf_dir)[1])


@query(f"WITH {FLOWS} SELECT pos, value FROM y ORDER BY abs(value) DESC, pos LIMIT 32")
def topk_buckets(spark, sf_dir):
    return steps.top_buckets(_base(spark, sf_dir)[1], DEFAULT.heavy_buckets)


@query(f"WITH {FLOWS} SELECT flow_id FROM cand")
def candidate_flows(spark, sf_dir):
    pattern, y = _base(spark, sf_dir)
    return steps.candidates(pattern, steps.heavy_buckets(y))


@query(f"WITH {FLOWS} SELECT flow_id, corr FROM corr JOIN cand USING (flow_id) ORDER BY abs(corr) DESC, flow_id LIMIT 1")
def restricted_best_flow(spark, sf_dir):
    pattern, y = _base(spark, sf_dir)
    return steps.restricted_best_flow(steps.correlate(pattern, y), steps.candidates(pattern, steps.heavy_buckets(y)))


# --- recovery as a whole

_TRUTH = "SELECT user_id AS key, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS estimate FROM events GROUP BY user_id"


def _rounded(df):
    return df.select("key", F.round("x").cast("bigint").alias("estimate"))


@query(_TRUTH)
def omp_full_recovery(spark, sf_dir):
    """With a step for each flow the sketch (or sketches, for many flows) gives back every total."""
    return _rounded(recovery.recover(packets.events(spark, sf_dir)))


@query(_TRUTH)
def omp_restricted_recovery(spark, sf_dir):
    return _rounded(recovery.recover(packets.events(spark, sf_dir), restricted=True))


#: Steps of a pursuit that leaves most flows alone, as far as SQL unrolls it.
TOP = 10
_FOUND = f"{FLOWS}, {pursuit(TOP)}, est AS (SELECT flow_id, key, true_x, coalesce(x, 0) AS x, x IS NOT NULL AS selected FROM flows LEFT JOIN found USING (flow_id))"


def _to_cents(df):
    return df.withColumn("x", F.round("x", 2) + 0.0)


@query(f"WITH {_FOUND} SELECT flow_id, key, true_x, round(x, 2) + 0.0 AS x, selected FROM est")
def omp_topk_recovery(spark, sf_dir):
    """Fewer steps than flows: which are taken, in which order, and what they then weigh."""
    return _to_cents(recovery.recover(packets.events(spark, sf_dir), TOP))


@query(f"WITH {_FOUND} SELECT flow_id, key, true_x, round(x, 2) + 0.0 AS x, selected FROM est")
def omp_distributed_topk(spark, sf_dir):
    """The same over partitioned flows."""
    return _to_cents(recovery.recover_distributed(packets.events(spark, sf_dir), TOP))


@query(f"WITH {_FOUND} SELECT flow_id, key, round(x, 2) + 0.0 AS x, selected FROM est")
def omp_from_sketch(spark, sf_dir):
    """From the counters and a list of keys alone."""
    p = packets.events(spark, sf_dir)
    return _to_cents(recovery.recover_from_sketch(sketch.build_sketch(p), p.select("seq", "key"), TOP))


@query(f"WITH {_FOUND} SELECT flow_id, key, round(x, 2) + 0.0 AS x, selected FROM est")
def stream_recovery(spark, sf_dir):
    """At the end of a stream's run, from the batches' counters and keys."""
    return _to_cents(streams.stream_recovery(_event_packets(spark, sf_dir), TOP))


@query()
def omp_restricted_topk(spark, sf_dir):
    """Fewer steps than flows, picked among the flows of heavy counters (tests hold it against brute force)."""
    return _to_cents(recovery.recover(packets.events(spark, sf_dir), TOP, restricted=True))


@query(f"WITH {FLOWS} SELECT flow_id, key, true_x, coalesce(x, 0) AS x, x IS NOT NULL AS selected FROM flows LEFT JOIN step1 USING (flow_id)")
def omp_distributed(spark, sf_dir):
    """The first step over partitioned flows, which closed-form SQL can check; omp_distributed_recovery takes all steps."""
    return recovery.recover_distributed(packets.events(spark, sf_dir), 1)


@query(_TRUTH)
def omp_distributed_recovery(spark, sf_dir):
    """The whole loop over partitioned flows, a task a sketch, with a step for each flow."""
    return _rounded(recovery.recover_distributed(packets.events(spark, sf_dir)))


@query("SELECT event_type, user_id AS key, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS estimate FROM events GROUP BY event_type, user_id")
def omp_grouped(spark, sf_dir):
    p = packets.table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("seq"), F.col("user_id").alias("key"), packets.cents("value").alias("weight"))
    return recovery.recover_grouped(p, "event_type").select("event_type", "key", F.round("x").cast("bigint").alias("estimate"))


@query(f"WITH {_FOUND} SELECT flow_id, key, true_x, round(x - true_x, 2) + 0.0 AS abs_err, CASE WHEN true_x <> 0 THEN round(abs(x - true_x) / true_x, 6) ELSE 0.0 END AS rel_err FROM est WHERE selected")
def recovery_error(spark, sf_dir):
    """Of a recovery with fewer steps than flows: where counters are shared the errors aren't 0."""
    found = metrics.recovery_error(recovery.recover(packets.events(spark, sf_dir), TOP))
    return found.select("flow_id", "key", "true_x", (F.round("abs_err", 2) + 0.0).alias("abs_err"), F.round("rel_err", 6).alias("rel_err"))


#: flow, key, truth, estimate, taken: estimates with errors of both signs.
_GIVEN = [(0, 7, 100.0, 90.0, True), (1, 8, 50.0, 50.5, True), (2, 9, 0.0, 3.0, True), (3, 10, 20.0, 0.0, False)]
_GIVEN_SQL = "est(flow_id, key, true_x, x, selected) AS (VALUES " + ", ".join(f"({f}::BIGINT, {k}::BIGINT, {t}::DOUBLE, {x}::DOUBLE, {s})" for f, k, t, x, s in _GIVEN) + ")"


def _given(spark):
    return spark.createDataFrame(_GIVEN, "flow_id bigint, key bigint, true_x double, x double, selected boolean")


@query(f"WITH {_GIVEN_SQL} SELECT sum((x - true_x) * (x - true_x)) FILTER (selected) / count(*) AS mse FROM est")
def recovery_mse(spark, sf_dir):
    return metrics.recovery_mse(_given(spark))


@query(f"WITH {_GIVEN_SQL} SELECT flow_id, key, true_x, x, x - true_x AS abs_err, CASE WHEN true_x <> 0 THEN abs(x - true_x) / true_x ELSE 0 END AS rel_err FROM est WHERE selected")
def recovery_error_given(spark, sf_dir):
    return metrics.recovery_error(_given(spark))


@query(f"WITH {_FOUND} SELECT round(sum((x - true_x) * (x - true_x)) FILTER (selected) / count(*), 1) + 0.0 AS mse FROM est")
def recovery_mse_topk(spark, sf_dir):
    return metrics.recovery_mse(recovery.recover(packets.events(spark, sf_dir), TOP)).select((F.round("mse", 1) + 0.0).alias("mse"))


# --- weights


@query(
    f"""WITH src AS ({EVENTS}) SELECT round(avg(weight), 6) AS mean, min(weight)::DOUBLE AS min, max(weight)::DOUBLE AS max, round(stddev_pop(weight), 6) AS stddev,
    median(weight)::DOUBLE AS median FROM src"""
)
def weight_stats(spark, sf_dir):
    rows = metrics.weight_stats(packets.events(spark, sf_dir))
    return rows.select(F.round("mean", 6).alias("mean"), "min", "max", F.round("stddev", 6).alias("stddev"), "median")


@query(
    f"""WITH src AS ({EVENTS}), s AS (SELECT min(weight)::DOUBLE AS lo, max(weight)::DOUBLE AS hi FROM src)
    SELECT (CASE WHEN hi = lo THEN 1 ELSE least(floor((weight - lo) * 50 / (hi - lo)) + 1, 50) END)::INTEGER AS bin, count(*) AS count FROM src, s GROUP BY 1"""
)
def weight_histogram(spark, sf_dir):
    return metrics.weight_histogram(packets.events(spark, sf_dir))


@query(f"WITH src AS ({EVENTS}), c AS (SELECT weight, count(*) AS n FROM src GROUP BY weight) SELECT weight, (sum(n) OVER (ORDER BY weight))::DOUBLE / (sum(n) OVER ())::DOUBLE AS share FROM c")
def weight_cdf(spark, sf_dir):
    return metrics.weight_cdf(packets.events(spark, sf_dir))


@query(
    """WITH f AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE AS w FROM orders GROUP BY 1),
    r AS (SELECT w, row_number() OVER (ORDER BY w DESC, o_custkey) AS rn, count(*) OVER () AS n, sum(w) OVER () AS total FROM f)
    SELECT divisor::INTEGER AS divisor, round(sum(w) FILTER (rn <= n // divisor) * 100 / max(total), 6) AS percent FROM r, (VALUES (10), (5), (2)) d(divisor) GROUP BY divisor"""
)
def traffic_concentration(spark, sf_dir):
    flows = fl.flow_table(packets.orders(spark, sf_dir))
    return metrics.traffic_concentration(flows).select("divisor", F.round("percent", 6).alias("percent"))


# --- generators

N, SEED = 2000, 12345


def _generator(distribution: str) -> None:
    sql = f"SELECT id, ({generators.weight_sql(distribution, N, SEED)})::BIGINT AS weight FROM range({N}) g(id)"

    def generate(spark, sf_dir):
        return generators.weights(spark, distribution, N, SEED)

    generate.__name__ = f"gen_{distribution}"
    query(sql)(generate)


for _d in generators.DISTRIBUTIONS:
    if _d != "zipf":
        _generator(_d)

_ZIPF = f"""WITH ranks AS (SELECT n AS rank, pow(n::DOUBLE, -1.2) AS p FROM range(1, 10001) g(n)),
    c AS (SELECT rank, CASE WHEN rank = 10000 THEN 1.0 ELSE sum(p) OVER (ORDER BY rank) / sum(p) OVER () END AS high FROM ranks),
    cdf AS (SELECT rank, high, coalesce(lag(high) OVER (ORDER BY rank), 0) AS low FROM c),
    u AS (SELECT id, {generators.random_sql("id", SEED, 6)} / {generators.PRIME}.0::DOUBLE AS u FROM range({N}) g(id))"""


@query(f"{_ZIPF} SELECT id, floor(least(greatest(100000 / pow(rank::DOUBLE, 1.2), 1.0), 100000.0))::BIGINT AS weight FROM u JOIN cdf ON u > low AND u <= high")
def gen_zipf(spark, sf_dir):
    return generators.weights(spark, "zipf", N, SEED)


def _key_oracle() -> str:
    a, b, c = generators.key_sql(SEED)
    bits = f"xor(xor((({a}) & 65535)::UBIGINT << 48, ({b})::UBIGINT << 16), (({c}) & 65535)::UBIGINT)"
    return f"SELECT id AS seq, ({bits})::VARCHAR AS key, ({generators.weight_sql('uniform', N, SEED)})::BIGINT AS weight FROM range({N}) g(id)"


@query(_key_oracle())
def gen_packets(spark, sf_dir):
    rows = generators.packets(spark, "uniform", N, SEED)
    return rows.select("seq", unsigned_text(F.col("key")).alias("key"), "weight")


def _generated_sketch(distribution: str) -> None:
    def build(spark, sf_dir):
        return sketch.build_sketch(generators.packets(spark, distribution, N, SEED))

    build.__name__ = f"gen_sketch_{distribution}"
    query(f"WITH {cms(generated(distribution, N, SEED))} {_SUM}")(build)

    def truth(spark, sf_dir):
        rows = fl.flow_table(generators.packets(spark, distribution, N, SEED))
        return rows.select("flow_id", unsigned_text(F.col("key")).alias("key"), "true_x")

    truth.__name__ = f"gen_flows_{distribution}"
    query(f"WITH src AS ({generated(distribution, N, SEED)}), k AS (SELECT key, min(seq) AS first, sum(weight)::DOUBLE AS true_x FROM src GROUP BY key) SELECT row_number() OVER (ORDER BY first, key) - 1 AS flow_id, key::VARCHAR AS key, true_x FROM k")(truth)


for _d in generators.DISTRIBUTIONS:
    _generated_sketch(_d)


@query(_key_oracle())
def gen_cached(spark, sf_dir):
    """Generated packets read from the cache that the first call has written."""
    folder = f"{streams.shared_folder(spark)}/generated"
    generators.cached(spark, folder, "uniform", N, SEED)
    rows = generators.cached(spark, folder, "uniform", N, SEED)
    return rows.select("seq", unsigned_text(F.col("key")).alias("key"), "weight")


@query(
    f"""WITH {cms(generated("zipf", N, SEED))}, c AS ({_SUM}) SELECT (SELECT count(*) FROM src) AS flows, (SELECT count(*) FROM c) AS cells, (SELECT sum(weight)::DOUBLE FROM src) AS truth,
    (SELECT sum(weight)::DOUBLE FROM src) AS recovered"""
)
def gen_end_to_end(spark, sf_dir):
    """Generated traffic, its sketch and flows, and the recovery of all of it."""
    p = generators.packets(spark, "zipf", N, SEED)
    cells = sketch.build_sketch(p)
    found = recovery.recover_from_sketch(cells, p.select("seq", "key"))
    one = found.agg(F.count("*").alias("flows"), (F.round(F.sum("x"), 3) + 0.0).alias("recovered"))
    return one.join(cells.agg(F.count("*").alias("cells"))).join(p.agg(F.sum("weight").cast("double").alias("truth"))).select("flows", "cells", "truth", "recovered")


# --- benchmark results

RUNS = [
    ("zipf", 10000, 100, "cpu", 120.0), ("zipf", 10000, 100, "cpu", 124.0), ("zipf", 10000, 100, "gpu", 30.0), ("zipf", 10000, 100, "gpu_opt", 12.0),
    ("zipf", 1000000, 100, "cpu", 9000.0), ("zipf", 1000000, 100, "gpu", 600.0), ("zipf", 1000000, 100, "gpu_opt", 150.0),
    ("uniform", 10000, 100, "cpu", 110.0), ("uniform", 500000, 50, "gpu", 80.0), ("bimodal", 500000, 100, "cpu", 4000.0),
]
_RUNS = "runs(distribution, n, k, impl, time_ms) AS (VALUES " + ", ".join(f"('{d}', {n}::BIGINT, {k}, '{i}', {t}::DOUBLE)" for d, n, k, i, t in RUNS) + ")"
_SUMMARY = """summary AS (SELECT distribution, n, k, impl, avg(time_ms) AS time_ms, stddev_pop(time_ms) AS stddev_ms, n / (avg(time_ms) / 1000) AS throughput FROM runs GROUP BY distribution, n, k, impl)"""
_LINES = ["RESULT,zipf,100000,100,cpu,12.345,0.678,8100445", "noise", "RESULT,zipf,1000", "RESULT,uniform,1000,50,gpu,1.500,0.100,666667", "RESULT,uniform,x,50,gpu,1.500,0.100,666667"]


def _summary(spark):
    return metrics.throughput_summary(spark.createDataFrame(RUNS, "distribution string, n bigint, k int, impl string, time_ms double"))


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT * FROM summary")
def throughput_summary(spark, sf_dir):
    return _summary(spark)


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT impl, n, time_ms FROM summary WHERE distribution = 'zipf' AND k = 100")
def time_by_n(spark, sf_dir):
    return metrics.time_by_n(_summary(spark), "zipf", 100)


@query(
    f"""WITH {_RUNS}, {_SUMMARY} SELECT distribution, coalesce(max(throughput) FILTER (impl = 'cpu'), 0) AS cpu, coalesce(max(throughput) FILTER (impl = 'gpu'), 0) AS gpu,
    coalesce(max(throughput) FILTER (impl = 'gpu_opt'), 0) AS gpu_opt FROM summary WHERE n = 10000 AND k = 100 GROUP BY distribution"""
)
def throughput_bars(spark, sf_dir):
    return metrics.throughput_bars(_summary(spark), 10000, 100, ("cpu", "gpu", "gpu_opt"))


@query(
    f"""WITH {_RUNS}, {_SUMMARY}, s AS (SELECT distribution, n, max(time_ms) FILTER (impl = 'cpu') AS cpu, max(time_ms) FILTER (impl = 'gpu') AS gpu FROM summary WHERE k = 100 GROUP BY 1, 2)
    SELECT distribution, n, coalesce(cpu / gpu, 0) AS speedup FROM s"""
)
def speedup_pivot(spark, sf_dir):
    return metrics.speedup(_summary(spark), 100)


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT * FROM summary WHERE n >= 500000 AND distribution = 'zipf'")
def stress_subset(spark, sf_dir):
    return metrics.stress(_summary(spark))


@query(
    f"""WITH {_RUNS}, {_SUMMARY} SELECT n, coalesce(max(time_ms) FILTER (impl = 'cpu') / max(time_ms) FILTER (impl = 'gpu_opt'), 0) AS speedup FROM summary
    WHERE k = 100 AND distribution = 'zipf' AND n IN (10000, 100000, 1000000) GROUP BY n"""
)
def report_speedup(spark, sf_dir):
    return metrics.report_speedup(_summary(spark))


@query(
    """SELECT * FROM (VALUES ('zipf', 100000::BIGINT, 100, 'cpu', 12.345::DOUBLE, 0.678::DOUBLE, 8100445.0::DOUBLE),
    ('uniform', 1000::BIGINT, 50, 'gpu', 1.5::DOUBLE, 0.1::DOUBLE, 666667.0::DOUBLE)) t(distribution, n, k, impl, time_ms, stddev_ms, throughput)"""
)
def result_lines(spark, sf_dir):
    return results.parse_lines(spark.createDataFrame([(x,) for x in _LINES], "value string"))


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT 'RESULT,' || distribution || ',' || n || ',' || k || ',' || impl || printf(',%.3f,%.3f,%.0f', time_ms, stddev_ms, throughput) AS line FROM summary")
def result_texts(spark, sf_dir):
    return _summary(spark).select(results.result_line().alias("line"))


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT distribution, n, k, impl, round(time_ms, 3) AS time_ms, round(stddev_ms, 3) AS stddev_ms, round(throughput) AS throughput FROM summary")
def result_round_trip(spark, sf_dir):
    """Results as lines in a text file, read back."""
    path = f"{streams.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    _summary(spark).select(results.result_line().alias("value")).write.text(path)
    return results.read_lines(spark, path)


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT distribution, n, k, impl, time_ms, stddev_ms, throughput FROM summary")
def result_csv(spark, sf_dir):
    path = f"{streams.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    results.save(_summary(spark), path)
    return results.load(spark, path)


@query(f"WITH {_RUNS}, {_SUMMARY} SELECT '| ' || distribution || ' | ' || n || ' | ' || k || ' | ' || impl || printf(' | %.3f | %.3f | %.0f |', time_ms, stddev_ms, throughput) AS line FROM summary")
def report_table(spark, sf_dir):
    """The rows of the Markdown report's table."""
    return results.report_rows(_summary(spark)).select("line")


# --- streams


def _event_packets(spark, sf_dir):
    return packets.as_event_packets(streams.event_stream(spark, sf_dir))


@query(f"WITH {cms(EVENTS)} {_SUM}")
def stream_sketch(spark, sf_dir):
    return streams.stream_sketch(_event_packets(spark, sf_dir))


@query(
    f"""WITH {cms("SELECT date_trunc('day', ts) AS day, user_id AS key, CAST(round(value * 100) AS BIGINT) AS weight FROM events")}
    SELECT strftime(day, '%Y-%m-%d') AS day, "row", col, (sum(weight) % 4294967296)::BIGINT AS value FROM p GROUP BY day, "row", col"""
)
def stream_windowed_sketch(spark, sf_dir):
    events = streams.event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), packets.cents("value").alias("weight"), "ts")
    rows = streams.stream_windowed_sketch(events, "ts", "1 day")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "row", "col", "value")


@query(f"WITH {FLOWS} SELECT flow_id, key, true_x FROM flows")
def stream_flow_table(spark, sf_dir):
    return streams.stream_flow_table(_event_packets(spark, sf_dir))


@query(_flags(EVENTS))
def stream_new_flow_flags(spark, sf_dir):
    """Each packet's flag as it arrives."""
    return streams.stream_new_flow_flags(_event_packets(spark, sf_dir))


@query(f"WITH {bloom(EVENTS)} SELECT DISTINCT min(seq) AS seq FROM p8 GROUP BY i, col")
def stream_new_flows(spark, sf_dir):
    return streams.stream_new_flows(_event_packets(spark, sf_dir))
