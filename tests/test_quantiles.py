"""Exact quantiles against Spark's percentile, which keeps all values."""

import random

import pytest
from pyspark.sql import functions as F

from meshcast.operators import quantiles, stats
from meshcast.plans import fixtures

SF = "/root/testdata/sf0.01"
P = (0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0)


def compared(df, value, by, **more):
    wanted = df.where(F.col(value).isNotNull()).groupBy(*([by] if by else [])).agg(*(F.percentile(F.col(value).cast("double"), F.lit(p)).alias(f"q{i}") for i, p in enumerate(P)))
    key = lambda r: str(r[0]) if by else ""
    found = quantiles.exact_quantiles(df, value, P, by, **more)
    a, b = (sorted((tuple(map(str, r)) for r in x.collect()), key=key) for x in (found, wanted))
    assert a == b or [[float(x) for x in r[bool(by) :]] for r in a] == [pytest.approx([float(x) for x in r[bool(by) :]], rel=1e-12, nan_ok=True) for r in b]


def test_of_observations(spark):
    obs = fixtures.view(spark, SF, "obs").cache()
    compared(obs, "temperature", None)
    compared(obs, "clearsky_ghi", "month")
    compared(obs, "ghi", "hour", bins=16)


def test_of_odd_values(spark):
    rng = random.Random(3)
    far = [1e308, -1e308, 5e-324, 1e300, 1.0, 1.0 + 2**-52, float("inf"), float("-inf"), float("nan"), None]
    rows = [(rng.choice(["a", "b", None]), rng.choice(far) if rng.random() < 0.2 else rng.lognormvariate(0, 30)) for _ in range(4000)] + [("c", 7.0), ("d", None), ("e", float("nan")), ("e", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for bins in (2, 64):
        compared(df.where("v is null or not isnan(v)").where("abs(v) < 1e307"), "v", "g", bins=bins)
    got = {r.g: r for r in quantiles.exact_quantiles(df, "v", (0.0, 1.0), "g").collect()}
    assert set(got) == {"a", "b", "c", "e", None} and got["c"][1:] == (7.0, 7.0) and got["e"].q0 == float("-inf") and str(got["e"].q1) == "nan" and got["a"].q0 == float("-inf")
    assert quantiles.exact_quantiles(df.limit(0), "v", P).count() == 0
    with pytest.raises(ValueError, match="bound"):
        quantiles.exact_quantiles(spark.range(2000).selectExpr("id", "id AS v"), "v", P, "id")


def test_statistics_take_either_way(spark, monkeypatch):
    obs = fixtures.view(spark, "/root/testdata/sf0.001", "obs").cache()
    few = [stats.describe(obs, ["ghi", "temperature"]).orderBy("variable").collect(), stats.boxplot(obs, "temperature").orderBy("month").collect(), stats.centre(obs, "ghi").collect()]
    monkeypatch.setattr(stats, "BUFFERED", 0)
    many = [stats.describe(obs, ["ghi", "temperature"]).orderBy("variable").collect(), stats.boxplot(obs, "temperature").orderBy("month").collect(), stats.centre(obs, "ghi").collect()]
    assert few == many


def test_spearman_matrix_of_odd_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, float("nan"), *map(float, range(5))]), rng.choice([None, -0.0, 0.0, 1.5]), rng.lognormvariate(0, 9), 4.0) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, pair double, same double")
    frame = df.toPandas().corr(method="spearman")
    found = stats.spearman_matrix(df, ["a", "b", "pair", "same"])
    for r in found.collect():
        want = frame.loc[r.a, r.b]
        assert r.r is None if want != want else r.r == pytest.approx(want, abs=1e-9)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert stats.spearman_matrix(df, ["a"]).count() == 0 and len(found.collect()) == 6 and "Window" in text
    assert all(r.r is None for r in stats.spearman_matrix(df.limit(0), ["a", "b"]).collect())
