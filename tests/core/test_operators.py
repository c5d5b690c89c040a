"""Operators against small expected values, sequential versions and the recovery's invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.config import DEFAULT, SketchConfig
from sluice.operators import flows, metrics, recovery, sketch, steps

PACKETS = "seq bigint, key bigint, weight bigint"


def make(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


@pytest.fixture(scope="module")
def tiny(spark):
    return make(spark, [(0, 1, 10), (1, 2, 20), (2, 1, 5)])


def test_tiny(spark, tiny):
    assert [r["is_new"] for r in sketch.new_flow_flags(tiny).orderBy("seq").collect()] == [True, True, False]
    s = sketch.build_sketch(tiny)
    assert sorted(r["value"] for r in s.collect()) == [15] * 4 + [20] * 4
    stats = sketch.run_stats(tiny).first()
    assert (stats.processed, stats.new_flows, stats.cms_total) == (3, 2, 140)
    table = flows.flow_table(tiny).orderBy("flow_id").collect()
    assert [(r.flow_id, r.key, r.true_x) for r in table] == [(0, 1, 15.0), (1, 2, 20.0)]
    p, y = flows.pattern(flows.flow_table(tiny)), sketch.flatten(s)
    corr = steps.correlate(p, y)
    assert {r.flow_id: r["corr"] for r in corr.collect()} == {0: 60.0, 1: 80.0}
    best = steps.best_flow(corr)
    assert best.first().flow_id == 1
    r1 = steps.residual(y, p, best.select("flow_id", (F.col("corr") / 4).alias("x")))
    assert steps.norm(r1).first()["norm"] == pytest.approx(30.0)
    got = recovery.recover(tiny).orderBy("flow_id").collect()
    assert [(r.x, r.selected) for r in got] == [(15.0, True), (20.0, True)]


def test_empty(spark):
    none = make(spark, [])
    assert sketch.build_sketch(none).count() == 0
    assert sketch.new_flow_flags(none).count() == 0
    stats = sketch.run_stats(none).first()
    assert (stats.processed, stats.new_flows, stats.cms_total, stats.bloom_ones) == (0, 0, 0, 0)
    assert flows.flow_table(none).count() == 0
    assert recovery.recover(none).count() == 0
    assert metrics.recovery_mse(recovery.recover(none)).first()["mse"] == 0.0
    assert metrics.weight_stats(none).first()["mean"] == 0.0


def test_edges(spark):
    rows = [(0, 0, 0), (1, -1, 7), (2, 0, 3), (3, 5, 0)]
    p = make(spark, rows)
    got = {r.key: r for r in recovery.recover(p).collect()}
    assert got[0].x == pytest.approx(3) and got[-1].x == pytest.approx(7)
    assert not got[5].selected and got[5].x == 0  # nothing to explain
    assert all(not r.selected for r in recovery.recover(p, 0).collect())
    assert sum(r.selected for r in recovery.recover(p, 1).collect()) == 1
    assert {r.key: r.x for r in recovery.recover(p, 99).collect()}[-1] == pytest.approx(7)


def test_counter_wraps(spark):
    p = make(spark, [(i, 9, 2**31) for i in range(3)])
    assert {r["value"] for r in sketch.build_sketch(p).collect()} == {(3 * 2**31) % 2**32}


def test_bloom_is_sequential(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(k), 1) for i, k in enumerate(rng.integers(0, 4000, 6000))]
    cells = {(r.key, r.i): r["col"] for r in sketch.bloom_cells(make(spark, rows).select("key").distinct()).collect()}
    bits, expected = set(), []
    for _, k, _ in rows:
        mine = {(i, cells[(k, i)]) for i in range(8)}
        expected.append(not mine <= bits)
        bits |= mine
    got = [r["is_new"] for r in sketch.new_flow_flags(make(spark, rows)).orderBy("seq").collect()]
    assert got == expected and sum(expected) < 4000


def reference_omp(y, positions, most, config=SketchConfig()):
    """Textbook loop with a Cholesky solve from scratch."""
    n = len(positions)
    phi = np.zeros((config.counters, n))
    for i, p in enumerate(positions):
        phi[p, i] = 1
    x, free, support, r = np.zeros(n), np.ones(n, bool), [], y.copy()
    for _ in range(min(most, n)):
        c = np.where(free, np.abs(phi.T @ r), -1)
        i = int(c.argmax())
        if c[i] <= 1e-9:
            break
        free[i] = False
        support.append(i)
        a = phi[:, support]
        try:
            x[support] = recovery.cholesky_solve(a.T @ a, a.T @ y)
        except np.linalg.LinAlgError:
            break
        r = y - phi @ x
        if np.sqrt(r @ r) < 1e-6:
            break
    return x, ~free, support


@pytest.mark.parametrize("flows_, columns", [(30, 16), (60, 64), (10, 4)])
def test_kernel_against_textbook(flows_, columns):
    config = SketchConfig(columns=columns)
    rng = np.random.default_rng(flows_)
    keys = rng.integers(0, 1 << 40, flows_)
    positions = recovery.positions_of(keys, config)
    truth = rng.integers(1, 1000, flows_).astype(float)
    y = np.bincount(positions.ravel(), weights=np.repeat(truth, 4), minlength=config.counters)
    for most in (1, 5, flows_):
        found = recovery.omp(y, positions, most, config)
        x, selected, support = reference_omp(y, positions, most, config)
        assert found.support == support and (found.selected == selected).all()
        assert np.allclose(found.x, x, atol=1e-6)


def test_same_positions_stop():
    """Two flows that the sketch can't tell apart: the second is taken with weight 0 and the loop ends."""
    positions = np.array([[0, 20, 40, 60], [0, 20, 40, 60], [1, 21, 41, 61]])
    y = np.zeros(65536)
    for p, w in zip(positions, (5, 5, 1)):
        y[p] += w
    solver = recovery.Solver(y)
    assert solver.add(positions[0]) and not solver.add(positions[1])
    found = recovery.omp(y, positions, 3)
    assert found.support[0] == 0 and found.x[0] == pytest.approx(10)


def test_ties_take_the_lowest_flow(spark):
    p = make(spark, [(0, 7, 5), (1, 8, 5), (2, 9, 5)])
    pat, y = flows.pattern(flows.flow_table(p)), sketch.flatten(sketch.build_sketch(p))
    assert steps.best_flow(steps.correlate(pat, y)).first().flow_id == 0
    assert steps.best_flow_by_parts(steps.correlate(pat, y), 3).first().flow_id == 0


def test_modes_agree(spark):
    rng = np.random.default_rng(5)
    p = make(spark, [(i, int(k), int(w)) for i, (k, w) in enumerate(zip(rng.integers(0, 80, 500), rng.integers(1, 1000, 500)))])
    local = {r.key: round(r.x, 6) for r in recovery.recover(p, 6).collect()}
    far = {r.key: round(r.x, 6) for r in recovery.recover_distributed(p, 6).collect()}
    grouped = {r.key: round(r.x, 6) for r in recovery.recover_grouped(p.withColumn("g", F.lit("a")), "g", 6).collect()}
    assert local == far == grouped
    full = {r.key: r for r in recovery.recover(p, restricted=True).collect()}
    assert all(round(r.x) == r.true_x for r in full.values())


def test_distributed_recovery_takes_a_step_for_each_flow(spark):
    from sluice.plans.registry import QUERIES

    got = QUERIES["omp_distributed_recovery"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 15 and all(r.estimate > 0 for r in got)
    p = make(spark, [(i, i % 9, 1 + i % 5) for i in range(40)])
    rows = recovery.recover_distributed(p).collect()
    assert len(rows) == 9 and all(r.selected and round(r.x) == r.true_x for r in rows)


def test_invariants(spark):
    rng = np.random.default_rng(6)
    p = make(spark, [(i, int(k), int(w)) for i, (k, w) in enumerate(zip(rng.integers(0, 300, 900), rng.integers(1, 50, 900)))])
    s = sketch.build_sketch(p)
    total = p.agg(F.sum("weight")).first()[0]
    assert {r.total for r in sketch.row_totals(s).collect()} == {total}
    halves = [sketch.build_sketch(p.filter(f"seq % 2 = {i}")) for i in (0, 1)]
    merged = {(r.row, r["col"], r.value) for r in sketch.merge_sketches(halves[0].union(halves[1])).collect()}
    assert merged == {(r.row, r["col"], r.value) for r in s.collect()}
    estimates = {r.key: r.estimate for r in sketch.point_estimates(p, s).collect()}
    truth = {r.key: r.w for r in p.groupBy("key").agg(F.sum("weight").alias("w")).collect()}
    assert all(estimates[k] >= truth[k] for k in truth)


def test_support_solution(spark):
    """A solved support leaves a residual that none of its flows correlates with."""
    rng = np.random.default_rng(8)
    p = make(spark, [(i, int(k), int(w)) for i, (k, w) in enumerate(zip(rng.integers(0, 400, 900), rng.integers(1, 50, 900)))])
    pat, y = flows.pattern(flows.flow_table(p)), sketch.flatten(sketch.build_sketch(p))
    top = steps.correlate(pat, y).orderBy(F.abs("corr").desc(), "flow_id").limit(25)
    x = recovery.solve_support(steps.gram(pat, top), top.withColumnRenamed("corr", "b"))
    left = steps.correlate(pat, steps.residual(y, pat, x)).join(x, "flow_id").agg(F.max(F.abs("corr"))).first()[0]
    assert left < 1e-6
    cells = sketch.dump(p).groupBy("kind").count().collect()
    assert {r.kind for r in cells} == {"cms", "bloom"}


def test_config():
    with pytest.raises(ValueError):
        SketchConfig(columns=1000)


def _brute_pursuit(y, positions, most, restricted=False, config=None):
    """Picks and coefficients by a plain least squares at each step."""
    from sluice.config import DEFAULT

    config = config or DEFAULT
    a = np.zeros((len(y), len(positions)))
    for f, p in enumerate(positions):
        a[p, f] = 1
    support, r, x = [], y.copy(), np.empty(0)
    for step in range(most):
        free = [f for f in range(len(positions)) if f not in support]
        some = free
        if restricted and step % config.full_scan_every:
            heavy = sorted((p for p in range(len(y)) if abs(r[p]) > config.heavy_share * abs(r).max()), key=lambda p: (-abs(r[p]), p))[: config.heavy_buckets]
            some = [f for f in free if set(positions[f].tolist()) & set(heavy)] or free
        best = max(some, key=lambda f: (abs(a[:, f] @ r), -f))
        if abs(a[:, best] @ r) <= config.least_correlation:
            break
        support.append(best)
        x = np.linalg.lstsq(a[:, support], y, rcond=None)[0]
        r = y - a[:, support] @ x
    return support, x


@pytest.mark.parametrize("restricted", [False, True])
@pytest.mark.parametrize("dense", [recovery.DENSE, 3])
def test_pursuit_against_plain_least_squares(restricted, dense, monkeypatch):
    """Fewer steps than flows, many shared counters, with the inverse and without it."""
    monkeypatch.setattr(recovery, "DENSE", dense)
    config = SketchConfig(columns=64, heavy_buckets=6)
    rng = np.random.default_rng(11)
    positions = recovery.positions_of(np.arange(1, 61, dtype=np.int64), config)
    y = np.bincount(positions.ravel(), weights=np.repeat(rng.integers(1, 10_000, 60).astype(float), 4), minlength=config.counters)
    found = recovery.omp(y, positions, 25, config, restricted)
    support, x = _brute_pursuit(y, positions, 25, restricted, config)
    assert found.support == support
    assert np.allclose(found.x[support], x, rtol=1e-7, atol=1e-5)


def test_restricted_is_kept_over_partitions(spark, monkeypatch):
    """Beyond what the driver takes the same flows are picked in the same way."""
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, int(k), int(w)) for i, (k, w) in enumerate(zip(rng.integers(1, 120, 300), rng.integers(1, 9_000, 300)))], "seq long, key long, weight long")
    config = SketchConfig(columns=64, heavy_buckets=6)
    for restricted in (False, True):
        near = {r.key: (round(r.x, 4), r.selected) for r in recovery.recover(p, 15, config, restricted).collect()}
        monkeypatch.setattr(recovery, "LOCAL_FLOWS", 0)
        far = {r.key: (round(r.x, 4), r.selected) for r in recovery.recover(p, 15, config, restricted).collect()}
        monkeypatch.undo()
        assert near == far


def test_recovery_from_counters_and_keys(spark):
    p = spark.createDataFrame([(1, 5, 10), (2, 6, 20), (3, 5, 5), (4, None, 7), (5, 8, None)], "seq long, key long, weight long")
    cells = sketch.build_sketch(p)
    got = {(r.key, round(r.x, 6), r.selected) for r in recovery.recover_from_sketch(cells, p.select("key")).collect()}
    assert got == {(5, 15.0, True), (6, 20.0, True), (8, 0.0, False)}
    assert {(r.key, r.true_x, round(r.x, 6)) for r in recovery.recover(p).collect()} == {(5, 15.0, 15.0), (6, 20.0, 20.0), (8, 0.0, 0.0)}
    assert recovery.recover_from_sketch(cells, p.select("key").filter("false")).count() == 0
    assert {r.seq for r in sketch.new_flow_flags(p).filter("is_new").collect()} == {1, 2, 5}
    assert cells.filter("col IS NULL").count() == 0 and cells.agg({"value": "sum"}).first()[0] == 4 * 35


def test_many_steps_over_many_flows():
    """A thousand steps over 150,000 flows: heavy flows stand out and come back."""
    keys = np.arange(150_000, dtype=np.int64)
    positions = recovery.positions_of(keys)
    rng = np.random.default_rng(1)
    truth = rng.integers(1, 5, len(keys)).astype(float)
    heavy = rng.choice(len(keys), 1000, replace=False)
    truth[heavy] += rng.integers(1_000_000, 9_000_000, 1000)
    y = np.bincount(positions.ravel(), weights=np.repeat(truth, 4), minlength=DEFAULT.counters)
    found = recovery.omp(y, positions, 1000, restricted=True)
    assert len(set(found.support) & set(heavy.tolist())) >= 990


def test_running_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(float(w), int(n)) for w, n in zip(rng.permutation(500), rng.integers(1, 9, 500))]
    df = spark.createDataFrame(rows, "w double, n long")
    for down in (False, True):
        got = {r.w: (r.s, r.total) for r in flows.running(df, "w", "n", "s", down).collect()}
        at, want = 0, {}
        for w, n in sorted(rows, reverse=down):
            at += n
            want[w] = (at, sum(n for _, n in rows))
        assert got == want
    for weights in ([], [3], [1, 2], [1, 1, 5, 9], [7, 7, 7], [None, 4]):
        p = spark.createDataFrame([(w,) for w in weights], "weight long")
        known = [w for w in weights if w is not None]
        assert metrics.weight_stats(p).first()["median"] == (float(np.median(known)) if known else 0.0)


def test_more_flows_than_a_sketch_determines(spark):
    """A step for each flow gives every total back, though one sketch has fewer counters than there are flows."""
    config = SketchConfig(columns=64)
    rows = [(i, i % 400, 1 + i * 7919 % 5000) for i in range(1200)]
    p = make(spark, rows)
    truth = {k: float(sum(w for _, key, w in rows if key == k)) for k in range(400)}
    for restricted in (False, True):
        got = {r.key: r for r in recovery.recover(p, None, config, restricted).collect()}
        assert {k: (round(r.x), r.true_x) for k, r in got.items()} == {k: (t, t) for k, t in truth.items()}
        assert sorted(r.flow_id for r in got.values()) == list(range(400))
    assert {r.key: round(r.x) for r in recovery.recover_distributed(p, None, config).collect()} == truth
    two = p.withColumn("g", F.lit("a")).union(p.filter("key < 3").withColumn("g", F.lit(None)))
    grouped = {(r.g, r.key): round(r.x) for r in recovery.recover_grouped(two, "g", None, config).collect()}
    assert grouped == {**{("a", k): t for k, t in truth.items()}, **{(None, k): truth[k] for k in range(3)}}
