import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import quantiles as Q


@pytest.mark.parametrize("n,parts", [(10, 1), (5_000, 3), (200_000, 14)])
def test_stated_error(n, parts):
    rng = np.random.default_rng(n)
    for values in (rng.pareto(1.2, n), rng.integers(0, 20, n).astype(float), np.sort(rng.normal(size=n)), np.zeros(n)):
        first, *rest = [Q.Compactors().add(v) for v in np.array_split(values, parts)]
        sketch = first.merge(rest)
        assert sketch.n == n and sum(map(len, sketch.levels)) <= max(n, 15_000)
        ordered = np.sort(values)
        points = ordered[(np.array([0, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999]) * (n - 1)).astype(int)]
        below, upto = sketch.counts(points)
        assert np.abs(below - np.searchsorted(ordered, points, "left")).max() <= Q.SHARE_ERROR * n
        assert np.abs(upto - np.searchsorted(ordered, points, "right")).max() <= Q.SHARE_ERROR * n


def test_protected_tail_is_exact_and_relative():
    n = 300_000
    values = np.random.default_rng(1).permutation(n).astype(float)
    for protect in ("high", "low"):
        sketch = Q.Compactors(protect=protect).add(values)
        back = Q.Compactors(protect=protect, n=sketch.n, levels=sketch.row()[1], counters=sketch.row()[2])
        for distance in (10, 100, 300, 3_000, 30_000):
            point = n - 1 - distance if protect == "high" else distance
            error = abs(back.counts(np.array([float(point)]))[0][0] - point)
            assert error <= (0 if distance <= 100 else 0.05 * distance)
    assert np.isnan(Q.Compactors().percentiles(np.array([0.5]))).all()


def test_in_spark(spark):
    rows = [(k % 3 if k % 7 else None, k % 2, float(k)) for k in range(3_000)] + [(0, 0, v) for v in (None, float("nan"), float("inf"), -999.0)]
    df = spark.createDataFrame(rows, "g int, day int, v double").withColumn("n", F.lit("clash"))
    daily = Q.sketches(df.repartition(5), ["g", "day"], ["v"], missing=(-999.0,))
    whole = Q.merged(daily, ["g", "field_name"])
    assert {(r.g, r.n) for r in whole.collect()} == {(g, sum(1 for a, _, v in rows if a == g and v is not None and 0 <= v < 1e9)) for g in (None, 0, 1, 2)}
    got = {r.g: r.pct_value for r in Q.percentiles(whole, ["g"], [50.0]).collect()}
    for g in (None, 0, 1, 2):
        own = sorted(v for a, _, v in rows if a == g and v is not None and 0 <= v < 1e9)
        assert abs(np.searchsorted(own, got[g]) / len(own) - 0.5) < 0.01
    asked = spark.createDataFrame([(1, 0, 0, 500.0), (1, 0, 1, 500.0), (2, 9, 0, 1.0)], "id long, g int, day int, point double")
    values = Q.long_values(df, ["g", "day"], ["v"], (-999.0,)).drop("field_name")
    for blocks in (1, 3):
        exact = {r.id: (r.n, r.below, r.upto) for r in Q.exact_counts(asked, values, ["g", "day"], "id", blocks).collect()}
        own = [v for a, _, v in rows if a == 0 and v is not None and 0 <= v < 1e9]
        assert exact == {1: (len(own), sum(v < 500 for v in own), sum(v <= 500 for v in own))}
        near = {r.id: r.below for r in Q.sketched_counts(asked, daily.drop("field_name"), ["g", "day"], "id", blocks=blocks).collect()}
        assert near[1] == pytest.approx(exact[1][1], abs=0.01 * len(own))
    assert Q.sketches(df.limit(0), ["g"], ["v"]).count() == 0


def test_merging_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(Q, "MERGE_FAN", 2)
    df = spark.range(0, 40_000, 1, 7).selectExpr("cast(id * 7919 % 40000 AS double) AS v", "CASE WHEN id % 3 > 0 THEN 1 END AS g")
    for keys in ([], ["g"]):
        made = Q.sketches(df, keys, ["v"])
        found = made.collect()
        assert sum(r.n for r in found) == 40_000 and len(found) == (2 if keys else 1)
        assert all(abs(r.pct_value - 20_000) < 400 for r in Q.percentiles(made, [*keys, "field_name"], [50.0]).collect())


def test_both_tails_have_multiplicative_errors():
    n, parts = 300_000, 60
    values = np.random.default_rng(4).lognormal(0, 2, n)
    ordered = np.sort(values)
    for protect, shares in (("low", (0.001, 0.01, 0.05)), ("high", (0.95, 0.99, 0.999))):
        first, *rest = [Q.Compactors(protect=protect, of=k).add(v) for k, v in enumerate(np.array_split(values, parts))]
        got = first.merge(rest).percentiles(np.array(shares))
        for share, value in zip(shares, got, strict=True):
            distance = min(share, 1 - share) * n
            assert abs(np.searchsorted(ordered, value, "right") - share * n) <= max(2, 0.05 * distance)


def test_open_sketches_are_sent_on(spark, monkeypatch):
    # with little room the sketches of a partition are sent in many pieces, which merge all the same
    monkeypatch.setattr(Q, "BUFFER_ROWS", 100)
    df = spark.range(0, 6_000, 1, 2).selectExpr("cast(id AS double) AS v", "id % 5 AS g")
    got = Q.sketches(df, ["g"], ["v"]).collect()
    assert sorted((r.g, r.n) for r in got) == [(g, 1_200) for g in range(5)]
