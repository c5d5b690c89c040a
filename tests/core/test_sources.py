import pytest
from pyspark.sql import functions as F

from sluice.operators import metrics
from sluice.sources import generators, results

RANGES = {"uniform": (1, 100), "zipf": (1, 100_000), "heavy_elephant": (1, 100_000), "heavy_mice": (1, 100_000), "bimodal": (1, 50_000)}


@pytest.mark.parametrize("name", generators.DISTRIBUTIONS)
def test_ranges(spark, name):
    df = generators.weights(spark, name, 3000)
    n, low, high = df.agg(F.count("*"), F.min("weight"), F.max("weight")).first()
    assert n == 3000 and RANGES[name][0] <= low and high <= RANGES[name][1]
    again = generators.weights(spark, name, 3000).repartition(3)
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in again.collect()}
    assert {tuple(r) for r in df.collect()} != {tuple(r) for r in generators.weights(spark, name, 3000, 9).collect()}


def test_shares(spark):
    assert generators.weights(spark, "heavy_elephant", 1000).filter("weight >= 10000").count() == 100
    assert generators.weights(spark, "heavy_mice", 1000).filter("weight >= 10000").count() == 100
    some = generators.weights(spark, "bimodal", 2000).filter("weight <= 10").count()
    assert 850 < some < 1150
    assert generators.weights(spark, "uniform", 0).count() == 0


def test_unknown(spark):
    with pytest.raises(ValueError, match="unknown distribution"):
        generators.weights(spark, "normal", 5)


def test_cache(spark, tmp_path):
    first = generators.cached(spark, str(tmp_path), "uniform", 50)
    files = sorted(p.name for p in tmp_path.rglob("part-*"))
    second = generators.cached(spark, str(tmp_path), "uniform", 50)
    assert sorted(p.name for p in tmp_path.rglob("part-*")) == files
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    assert first.select("key").distinct().count() == 50


def test_results(spark, tmp_path):
    lines = ["RESULT,zipf,10000,100,cpu,12.345,0.678,810045", "x", "RESULT,zipf,1,2", "RESULT,zipf,1e,100,cpu,1,1,1", "RESULT,zipf,10000,100,gpu_opt,1.5,0.1,6666667"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    got = results.read_lines(spark, str(tmp_path / "log.txt"))
    assert {r.impl for r in got.collect()} == {"cpu", "gpu_opt"}
    assert lines[0] in [r[0] for r in got.select(results.result_line()).collect()]
    results.save(got, str(tmp_path / "csv"))
    assert sorted(map(tuple, results.load(spark, str(tmp_path / "csv")).collect())) == sorted(map(tuple, got.collect()))
    text = results.report(got)
    assert "| zipf | 10000 | 100 | cpu | 12.345 |" in text and "| 10000 | 8.23 |" in text
    assert metrics.report_speedup(got).first().speedup == pytest.approx(12.345 / 1.5)
