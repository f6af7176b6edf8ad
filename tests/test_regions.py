import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators.regions import ear_clip, near_counts, near_pairs, polygon_errors, regions_of_points


def area(x, y, t):
    return sum(abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2 for a, b, c in t)


def test_ear_clipping():
    x, y = np.array([0, 4, 4, 2, 0.0]), np.array([0, 0, 4, 1, 4.0])
    assert area(x, y, ear_clip(x, y)) == pytest.approx(10)
    assert area(x, y, ear_clip(x[::-1], y[::-1])) != 0
    assert ear_clip(np.array([0, 1.0]), np.array([0, 1.0])) == []
    assert ear_clip(np.array([0, 1, 2.0]), np.array([0, 1, 2.0])) == []
    star = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    r = np.where(np.arange(24) % 2, 1.0, 0.4)
    x, y = r * np.cos(star), r * np.sin(star)
    whole = abs(sum(x[k] * y[(k + 1) % 24] - x[(k + 1) % 24] * y[k] for k in range(24))) / 2
    assert area(x, y, ear_clip(x, y)) == pytest.approx(whole)


def test_points_in_polygons(spark):
    polygons = spark.createDataFrame([(1, [0.0, 4.0, 4.0, 2.0, 0.0], [0.0, 0.0, 4.0, 1.0, 4.0]), (2, [4.0, 8.0, 8.0, 4.0], [0.0, 0.0, 4.0, 4.0]), (3, None, None), (2, [4.0, 8.0, 8.0, 4.0], [0.0, 0.0, 4.0, 4.0])], "rid long, xs array<double>, ys array<double>")
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 3.0), (3, 4.0, 2.0), (4, 5.0, 1.0), (5, 2.0, 0.5), (6, None, 1.0), (7, float("nan"), 1.0), (4, 5.0, 1.0)], "pid long, x double, y double")
    got = {(r.pid, r.rid) for r in regions_of_points(points, polygons, "pid", "rid", 3.0).collect()}
    assert got == {(1, 1), (3, 1), (3, 2), (4, 2), (5, 1)}
    one = {(r.pid, r.rid) for r in regions_of_points(points, polygons, "pid", "rid", 3.0, one_region=True, tile_points=1).collect()}
    assert one == {(1, 1), (3, 1), (4, 2), (5, 1)}
    # a polygon that crosses itself is an error row, not the end of the job
    bad = spark.createDataFrame([(9, [0.0, 4.0, 4.0, 0.0], [0.0, 4.0, 0.0, 4.0]), (10, [0.0, 1.0], [0.0, 1.0]), (11, [0.0, 1.0, float("nan")], [0.0, 0.0, 1.0])], "rid long, xs array<double>, ys array<double>")
    every = polygons.unionByName(bad)
    errors = {r.rid: r.error for r in polygon_errors(every, "rid").collect()}
    assert set(errors) == {3, 9, 10, 11} and errors[3] == "no corners" and errors[10] == "no area"
    assert {(r.pid, r.rid) for r in regions_of_points(points, every, "pid", "rid").collect()} == got
    # the same in two planes, which do not see each other
    planes = lambda df, ids: df.withColumn("plane", F.lit(0)).unionByName(df.withColumn("plane", F.lit(1)).withColumn(ids, F.col(ids) + 100))
    two = {(r.pid, r.rid) for r in regions_of_points(planes(points, "pid"), planes(polygons, "rid"), "pid", "rid", space="plane").collect()}
    assert two == got | {(a + 100, b + 100) for a, b in got}


@pytest.mark.parametrize("side,reach,tile", [(10.0, 2.0, 2000), (10.0, 2.0, 3), (5.0, 2.4, 3), (3.0, 2.0, 5)])
def test_near_pairs_against_brute_force(spark, side, reach, tile):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-1, side + 1, (120, 3))
    xyz[5] = xyz[6]
    rows = [(k, k % 2, *map(float, p), side, reach) for k, p in enumerate(xyz)] + [(500, 0, None, 1.0, 1.0, side, reach), (501, 0, float("nan"), 1.0, 1.0, side, reach), (0, 0, *map(float, xyz[0]), side, reach)]
    df = spark.createDataFrame(rows, "hid long, box int, x double, y double, z double, side double, reach double")
    want = set()
    for a in range(120):
        for b in range(a + 1, 120):
            d = xyz[a] - xyz[b]
            d -= side * np.rint(d / side)
            if a % 2 == b % 2 and (d**2).sum() <= reach**2:
                want.add((a, b))
    pairs = near_pairs(df, "hid", "box", tile_points=tile)
    got = [tuple(sorted((r.region_id, r.point_id))) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r.hid: r.n_near for r in near_counts(df, pairs, "hid").collect()}
    assert counts[500] == 0 and counts[7] == sum(7 in p for p in want)


def test_near_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "hid long, box int, x double, y double, z double, side double, reach double")
    assert near_pairs(df, "hid", "box").count() == 0
