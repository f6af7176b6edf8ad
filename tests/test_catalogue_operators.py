import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import cosmology as C
from skylattice.functions import normal
from skylattice.operators import environment, fields, filters, grid, matching, ranks, stats, tails

NAN = float("nan")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_filters(spark):
    df = frame(spark, [(-1, 1e12, 0.5), (10, 1e12, 0.4), (-1, 0.0, 0.3), (-1, 1e12, NAN), (None, 1e12, 1.0), (-1, NAN, 1.0)], "pid long, m200b double, cv double")
    assert filters.hosts(df).count() == 1
    m = frame(spark, [(1e10,), (2e10,), (2.5e10,), (3e10,), (NAN,), (None,)], "m200b double")
    counts = [filters.mass_range(m, *r).count() for r in ((2e10, None), (None, 2.5e10), (2e10, 2.5e10))]
    assert counts == [3, 3, 2] and filters.mass_range(m).count() == 6
    with pytest.raises(ValueError):
        filters.mass_range(m, 3, 2)
    f = frame(spark, [(0.8, 0.2), (NAN, 0.3), (1.1, NAN), (float("inf"), 1.0)], "env double, t double")
    assert filters.finite_features(f, ["env", "t"]).count() == 1
    with pytest.raises(ValueError):
        filters.require(f, ["zz"])
    with pytest.raises(ValueError):
        filters.attach(f, ["a"], {})
    edges = frame(spark, [(0.9,), (1.0,), (1.5,), (2.0,), (None,), (NAN,)], "v double").select(C.bin_of(F.col("v"), [1.0, 2.0]).alias("a"), C.bin_of(F.col("v"), [1.0, 2.0], True).alias("b")).collect()
    assert [r.a for r in edges] == [None, 0, 0, None, None, None] and [r.b for r in edges][3] == 0


def test_cosmology(spark):
    r = spark.range(1).select(C.r200b(F.lit(1e12), 0.3089, 0.6774).alias("r")).withColumn("m", C.m200b(F.col("r"), 0.3089, 0.6774)).first()
    rho = 0.3089 * 2.775e11 * 0.6774**2
    assert r.r == pytest.approx((3e12 / (800 * math.pi * rho)) ** (1 / 3)) and r.m == pytest.approx(1e12)
    waves = [r.k for r in spark.range(10).select(C.wave_number(F.col("id"), 10, 100.0).alias("k")).collect()]
    assert np.allclose(waves, 2 * np.pi * np.fft.fftfreq(10, 10.0))
    assert len(C.smoothing_scales()) == 19 and C.smoothing_scales()[-1] == pytest.approx(4.0)
    x = np.linspace(-4, 4, 41)
    assert np.allclose(normal.ppf(normal.cdf(x)), x, atol=1e-6)


PARTICLES = [(1.0, 1.0, 1.0), (2.9, 1.0, 0.0), (0.0, 0.0, 2.9), (1.0, 2.0, 0.0), (0.0, 2.9, 0.0), (2.9, 0.0, 0.0)]


def test_deposit(spark):
    pts = frame(spark, [(0, 3.0, *p) for p in PARTICLES] + [(0, 3.0, None, 1.0, 1.0), (0, 3.0, NAN, 1.0, 1.0)], "box int, side double, x double, y double, z double")
    got = {(r.i, r.j, r.k): r.v for r in grid.cloud_in_cell(pts, 3).collect() if abs(r.v) > 1e-12}
    want = {(1, 1, 1): 1, (2, 1, 0): 0.1, (0, 1, 0): 0.9, (0, 0, 2): 0.1, (0, 0, 0): 2.7, (1, 2, 0): 1, (0, 2, 0): 0.1, (2, 0, 0): 0.1}
    assert got == pytest.approx(want)
    delta = grid.full_grid(grid.overdensity(grid.cloud_in_cell(pts, 3), 3), 3, -1.0)
    assert delta.count() == 27 and delta.agg(F.avg("v")).first()[0] == pytest.approx(0)
    cells = frame(spark, [(0, 10.0, 2.5, 5.0, 7.5), (0, 10.0, 0.0, 4.0, 8.0), (0, 10.0, 9.5, 1.0, 3.0), (0, 10.0, -0.5, 10.0, 3.0)], "box int, side double, x double, y double, z double")
    assert [(r.i, r.j, r.k) for r in grid.nearest_cells(cells, 5).collect()] == [(1, 2, 3), (0, 2, 4), (4, 0, 1), (4, 0, 1)]
    assert grid.cloud_in_cell(pts.limit(0), 3).count() == 0


def halos(spark, xs, masses, side, first=0):
    return frame(spark, [(first + k, 0, side, float(x), 0.0, 0.0, m) for k, (x, m) in enumerate(zip(xs, masses))], "id long, box int, side double, x double, y double, z double, m200b double")


def matched(hr, lr, k=10, reach=5.0, passes=None):
    got = matching.match_one_to_one(hr, lr, k, F.lit(reach), F.lit(0.95), passes)
    return {r.hr_id: (r.lr_id, round(r.distance, 6)) for r in got.collect()}


def test_matching(spark):
    h = lambda xs, side, ms=None: halos(spark, xs, ms or [1e12] * len(xs), side)
    assert matched(h([0.5], 10.0), h([9.5], 10.0), reach=2.0) == {0: (0, 1.0)}
    assert matched(h([1.0], 10.0), h([1.1], 10.0, [1e10])) == {}
    hr, lr = h([0.2, 0.05], 20.0), h([0.0, 3.0], 20.0)
    assert matched(hr, lr, k=2, passes=1) == {1: (0, 0.05)}
    assert matched(hr, lr, k=2) == {1: (0, 0.05), 0: (1, 2.8)}
    assert matched(h([4.0, 6.0], 20.0), h([5.0], 20.0), k=1) == {0: (0, 1.0)}
    assert matched(h([1.0], 10.0).limit(0), h([1.0], 10.0)) == {}
    rng = np.random.default_rng(0)
    got = matched(h(list(rng.uniform(0, 10, 30)), 10.0), h(list(rng.uniform(0, 10, 20)), 10.0))
    assert len({v[0] for v in got.values()}) == len(got)


def test_ranks(spark):
    ref = frame(spark, [(1, k, float(m)) for k, m in enumerate(np.linspace(1e11, 1e12, 20))], "g int, id long, m double")
    tgt = frame(spark, [(1, 0, 1e11), (1, 1, 5e11), (1, 2, 1e12), (1, 3, NAN), (1, 4, None), (2, 9, 1e12)], "g int, id long, m double")
    got = {r.id: r.matched_mass for r in ranks.abundance_match(tgt, ref, ["g"], "m", "id").collect()}
    top = sorted(np.linspace(1e11, 1e12, 20))[::-1]
    assert got == pytest.approx({2: top[0], 1: top[1], 0: top[2], 9: None})
    tied = frame(spark, [(1, 3.0), (1, 1.0), (1, 3.0), (1, 2.0), (None, 5.0), (1, None)], "g int, v double")
    assert sorted((r.v, r.r) for r in ranks.average_ranks(tied, ["g"], "v", "r").collect() if r.v is not None) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5), (5.0, 1.0)]
    many = spark.range(5000).selectExpr("id", "id % 3 AS g", "(id * 7919) % 5000 AS v")
    rows = ranks.row_numbers(many.repartition(7), ["g"], [F.desc("v"), F.asc("id")]).collect()
    for g in range(3):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and all(a.v > b.v for a, b in zip(own, own[1:]))


def test_statistics(spark):
    df = frame(spark, [(0, 2.0), (1, 0.0), (1, 2.0), (2, None), (2, NAN)], "g int, v double")
    sem = {r.g: r.s for r in df.groupBy("g").agg(stats.standard_error(stats.known("v")).alias("s")).collect()}
    assert sem == {0: 0.0, 1: 1.0, 2: None}
    hist = frame(spark, [(0, k, 0, s) for k, s in enumerate((0.5, 0.3, 0.2))], "g int, bx int, by int, share double")
    levels = [r.threshold for r in stats.density_levels(hist, ["g"]).orderBy("threshold").collect()]
    assert len(levels) == 4 and levels[-1] == 1.0 and levels == sorted(levels)
    flat = stats.density_levels(frame(spark, [(0, 0, 0, 1.0)], "g int, bx int, by int, share double"), ["g"]).collect()
    assert sorted(r.threshold for r in flat) == pytest.approx([0.4, 0.68, 0.95, 1.0])
    with pytest.raises(ValueError):
        stats.log_median_by_mass(df, [1e10, 1e11], "v", [])
    firsts = stats.first_per_key(frame(spark, [(1, 2, "b"), (1, 1, "a"), (None, 5, "c")], "k int, o int, v string"), ["k"], [F.col("o")])
    assert {(r.k, r.v) for r in firsts.collect()} == {(1, "a"), (None, "c")}
    hmf = stats.mass_function(frame(spark, [(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "m200b double").withColumn("g", F.lit(0)), [1.0, 2.0, 4.0], ["g"])
    assert [r.n for r in hmf.orderBy("bin").collect()] == [1, 2]


def test_joint_tails_against_bisection(spark):
    rng = np.random.default_rng(2)
    for ties in (False, True):
        x = rng.normal(size=(300, 2)).round(1 if ties else 12)
        df = frame(spark, [(0, k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(0, 999, None, 1.0)], "g int, id long, a double, b double")
        got = tails.joint_percentile(df, ["g"], ["a", "b"], "id").first()
        low, high = 1e-6, 99.99
        for _ in range(64):
            mid = (low + high) / 2
            inside = (x < np.percentile(x, mid, axis=0)).all(axis=1).mean()
            low, high = (low, mid) if inside >= 0.25 else (mid, high)
        assert got.n == 300 and got.p == pytest.approx(high, abs=1e-6)
        marked = tails.in_tails(df, tails.tail_limits(df, ["g"], ["a", "b"], spark.createDataFrame([got])), ["g"], ["a", "b"])
        share = marked.agg(F.avg(F.col("lower").cast("int")), F.avg(F.col("upper").cast("int"))).first()
        assert 0.15 < share[0] < 0.35 and 0.15 < share[1] < 0.4


def test_fourier(spark):
    n, side = 6, 10.0
    v = np.random.default_rng(1).normal(size=(n, n, n))
    rows = [(0, i, j, k, float(v[i, j, k])) for i in range(n) for j in range(n) for k in range(n)]
    delta, sides = frame(spark, rows, "space int, i int, j int, k int, v double"), frame(spark, [(0, side)], "space int, side double")
    cube = lambda df, c: _cube(df, c, n)
    spec = fields.spectrum(delta, n)
    assert np.allclose(cube(spec, "re") + 1j * cube(spec, "im"), np.fft.fftn(v))
    k = 2 * np.pi * np.fft.fftfreq(n, side / n)
    kx, ky, kz = np.meshgrid(k, k, k, indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    w = np.exp(-k2 * 1.5**2 / 2)
    smooth = np.fft.ifftn(np.fft.fftn(v) * w).real
    assert np.allclose(cube(fields.smoothed(delta, sides, n, 1.5), "v"), smooth)
    t = fields.tidal_tensors(delta, sides, n, [1.5], kind="double")
    want = np.fft.ifftn(np.fft.fftn(v) * w * np.divide(kx * kz, k2, out=np.zeros_like(k2), where=k2 > 0)).real
    assert np.allclose(cube(t, "t02"), want)
    assert np.allclose(cube(t, "t00") + cube(t, "t11") + cube(t, "t22"), smooth - smooth.mean())
    other = fields.tidal_tensors(delta, sides, n, [1.5], physical=False, kind="double")
    assert np.allclose(cube(other, "t11"), want)
    flat = fields.bias_field(delta.withColumn("v", F.lit(0.0)), sides, n, 5.0)
    assert np.allclose(cube(flat, "v"), 0)
    pts = frame(spark, [(1, 0, side, 0.0, 0.0, 0.0), (2, 0, side, side / n / 2, 0.0, 0.0)], "id long, box int, side double, x double, y double, z double")
    got = {r.id: r.v for r in grid.trilinear(pts, delta, n).collect()}
    assert got == pytest.approx({1: v[0, 0, 0], 2: (v[0, 0, 0] + v[1, 0, 0]) / 2})


def _cube(df, column, n):
    out = np.zeros((n, n, n))
    for r in df.collect():
        out[r.i, r.j, r.k] = r[column]
    return out


def test_environment(spark):
    rng = np.random.default_rng(4)
    m = [np.eye(3) * 2, np.diag([1.0, 2, 3]), *[(lambda a: a + a.T)(rng.normal(size=(3, 3))) for _ in range(20)]]
    df = frame(spark, [tuple(map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for a in m], ", ".join(f"{c} double" for c in environment.COMPONENTS))
    got = [r.l for r in df.select(environment.eigenvalues(*[F.col(c) for c in environment.COMPONENTS]).alias("l")).collect()]
    assert np.allclose(got, [np.linalg.eigvalsh(a) for a in m], atol=1e-7)
    s = frame(spark, [(0.75,), (1.5,), (0.1,), (5.0,), (None,)], "rg double")
    assert [(r.s0, r.s1) for r in environment.scale_brackets(s, [0.5, 1.0, 2.0]).collect()] == [(0.5, 1.0), (1.0, 2.0)]
    v = spark.range(1).select(C.linear_in_scale(F.lit(0.0), F.lit(10.0), F.lit(0.5), F.lit(1.5), F.lit(1.0)).alias("v")).first().v
    assert v == 5.0
    desc = frame(spark, [(10, 20, 30, 2, 0.1), (10, 20, 30, 1, 0.42)], "cell_x int, cell_y int, cell_z int, b int, alpha double")
    h = frame(spark, [(1, 10, 20, 30), (2, 0, 0, 0)], "id long, cell_x int, cell_y int, cell_z int")
    assert {r.id: r.alpha for r in environment.attach_by_cell(h, desc, ["cell_x", "cell_y", "cell_z"], [F.col("b")], ["alpha"]).collect()} == {1: 0.42, 2: None}


def test_quantiles_and_ranks_with_a_hot_group_and_value(spark):
    # a group with most rows, most of them of one value; a null group; unknown values
    rows = [(1, 5.0)] * 400 + [(1, float(k)) for k in range(100)] + [(None, 3.0), (None, 4.0), (2, None), (2, float("nan")), (3, 7.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.n, r.low, r.mid) for r in ranks.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    hot = np.array([v for g, v in rows if g == 1])
    assert got == {1: (500, np.quantile(hot, 0.1), 5.0), None: (2, pytest.approx(3.1), 3.5), 3: (1, 7.0, 7.0)}
    whole = ranks.quantiles(df, [], "v", {"mid": 0.5}).first()
    assert (whole.n, whole.mid) == (503, 5.0)
    assert ranks.quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).count() == 0
    ranked = {(r.g, r.v): r["rank"] for r in ranks.average_ranks(df, ["g"], "v").collect() if r.v == r.v}
    assert ranked[(1, 5.0)] == np.mean([k + 1 for k, v in enumerate(np.sort(hot)) if v == 5.0]) and ranked[(3, 7.0)] == 1 and ranked[(2, None)] is None
