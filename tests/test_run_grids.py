import re

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import fields, grid
from skylattice.plans import catalog_queries as q

GRIDS = {1: (4, 8.0), 2: (6, 12.0)}


def tables(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(100 * run + k, -1, run, run, *map(float, rng.uniform(0, side, 3)), 1e12, 1.0, 1.0, 1.0, 1.0) for run, (_, side) in GRIDS.items() for k in range(30)]
    columns = ", ".join(f"{c} double" for c in ("halo_x", "halo_y", "halo_z", "m200b", "cv", "spin", "ca", "ba"))
    spark.createDataFrame(rows, f"halo_id long, pid long, run_id int, box_id int, {columns}").write.parquet(f"{folder}/hr_halos.parquet")
    runs = [(run, n, side, 1.0, 1.0, 0.9, 0.3, 0.7, 1e9) for run, (n, side) in GRIDS.items()]
    columns = ", ".join(f"{c} double" for c in ("boxsize_mpc_h", "r_match_mpc_h", "env_radius_mpc_h", "max_mass_distance", "omega_matter", "h0", "mass_particle"))
    spark.createDataFrame(runs, f"run_id int, n_grid int, {columns}").write.parquet(f"{folder}/sim_runs.parquet")
    return rows


def overdensities(rows):
    cubes = {run: np.zeros((n,) * 3) for run, (n, _) in GRIDS.items()}
    for row in rows:
        n, side = GRIDS[row[3]]
        g = np.array(row[4:7]) / (side / n)
        low, part = np.floor(g).astype(int), g - np.floor(g)
        for d in np.ndindex(2, 2, 2):
            cubes[row[3]][tuple((low + d) % n)] += np.prod(np.where(d, part, 1 - part))
    return {run: cube / cube.mean() - 1 for run, cube in cubes.items()}


def test_each_run_has_its_own_grid_and_all_scales(spark, tmp_path):
    want = overdensities(tables(spark, tmp_path))
    got = q.QUERIES["a4_overdensity_run_grid"](spark, str(tmp_path)).collect()
    assert len(got) == 4**3 + 6**3
    assert all(abs(row.delta - want[row.space][row.i, row.j, row.k]) < 2e-6 for row in got)
    assert len(q.RUN_SCALES) == 19 and np.allclose(q.RUN_SCALES, np.geomspace(1000 / 4096, 4, 20)[1:])
    expected = {}
    for run, (n, side) in GRIDS.items():
        k = 2 * np.pi * np.fft.fftfreq(n, side / n)
        k = np.stack(np.meshgrid(k, k, k, indexing="ij"))
        k2 = (k**2).sum(axis=0)
        for scale in q.RUN_SCALES:
            for name in ("t00", "t01", "t02", "t11", "t12", "t22"):
                factor = k[int(name[1])] * k[int(name[2])] / np.where(k2 > 0, k2, 1) * np.exp(-k2 * scale**2 / 2)
                expected[run, scale, name] = np.fft.ifftn(np.fft.fftn(want[run]) * factor).real
    got = q.QUERIES["m9_tidal_tensor_run_grid"](spark, str(tmp_path)).collect()
    assert len(got) == 19 * (4**3 + 6**3)
    for row in got:
        for name in ("t00", "t01", "t02", "t11", "t12", "t22"):
            assert abs(row[name] - expected[row.space, row.scale, name][row.i, row.j, row.k]) < 1e-4


def test_halos_read_their_own_grid(spark, tmp_path):
    rows = tables(spark, tmp_path)
    want = overdensities(rows)
    got = {row.id: row.delta for row in q.QUERIES["j10_trilinear_run_grid"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for row in rows:
        n, side = GRIDS[row[3]]
        g = np.array(row[4:7]) / (side / n)
        low, part = np.floor(g).astype(int), g - np.floor(g)
        value = sum(np.prod(np.where(d, part, 1 - part)) * want[row[3]][tuple((low + d) % n)] for d in np.ndindex(2, 2, 2))
        assert abs(got[row[0]] - value) < 2e-6


def test_full_grid_does_not_shuffle_the_cells_it_adds(spark):
    given = spark.createDataFrame([(1, 0, 0, 0, 2.5), (1, 31, 5, 31, 0.5), (None, 3, 3, 3, 1.0), (2, 40, 0, 0, 9.0), (2, 1, 1, 1, None)], "space int, i int, j int, k int, v double")
    got = grid.full_grid(given, 32, -1.0)
    rows = got.where("v <> -1").collect()
    assert {(r.space, r.i, r.j, r.k, r.v) for r in rows} == {(1, 0, 0, 0, 2.5), (1, 31, 5, 31, 0.5), (None, 3, 3, 3, 1.0)}
    sizes = {r.space: (r["n"], r.cells) for r in got.groupBy("space").agg(F.count("*").alias("n"), F.countDistinct("i", "j", "k").alias("cells")).collect()}
    assert sizes == {s: (32**3, 32**3) for s in (1, 2, None)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert grid.full_grid(given.limit(0), 32, -1.0).count() == 0


def _sparse(spark, n, side):
    v = np.where(np.random.default_rng(n).random((n, n, n)) < 0.2, np.random.default_rng(n).normal(size=(n, n, n)), -1.0)
    rows = [(s, *map(int, at), float(v[tuple(at)])) for s in (1, 2) for at in np.argwhere(v != -1)]
    k = 2 * np.pi * np.fft.fftfreq(n, side / n)
    return v, spark.createDataFrame(rows, "space int, i int, j int, k int, v double"), spark.createDataFrame([(1, side), (2, side)], "space int, side double"), np.stack(np.meshgrid(k, k, k, indexing="ij"))


def test_halo_bias_of_sparse_cells_equals_numpy(spark):
    for n, k_max in ((6, 1.5), (7, 50.0)):
        side = 10.0
        v, delta, sides, k = _sparse(spark, n, side)
        size, wave = np.sqrt((k**2).sum(axis=0)), np.fft.fftn(v) / n**3
        kept = np.where((size > 0) & (size <= k_max), wave / np.maximum(np.abs(wave) ** 2 * side**3, 1e-30), 0)
        want = np.fft.ifftn(kept).real * n**3
        halos = spark.createDataFrame([(1, 1, side, *[c * side / n for c in (0.0, 1.0, 2.0)]), (2, 2, side, *[c * side / n for c in (n - 0.5, 3.0, 3.0)])], "id int, box int, side double, x double, y double, z double")
        got = {r.id: r.v for r in fields.halo_bias(halos, delta, sides, n, k_max, empty=-1.0).collect()}
        assert np.allclose([got[1], got[2]], [want[0, 1, 2], (want[n - 1, 3, 3] + want[0, 3, 3]) / 2])


def test_tensors_in_some_cells_equal_numpy(spark):
    # the first has few cells wanted, so that pairs are summed, the second all, so that the cube is transformed
    for n, every in ((6, 40), (7, 40), (6, 1), (7, 1)):
        v, delta, sides, k = _sparse(spark, n, 10.0)
        k2 = (k**2).sum(axis=0)
        wanted = [(s, scale, *map(int, at)) for s in (1, 2) for scale in (0.5, 1.5) for at in list(np.ndindex(n, n, n))[::every]]
        got = fields.tidal_tensors_at(spark.createDataFrame(wanted, "space int, scale double, i int, j int, k int"), delta, sides, n, [0.5, 1.5], empty=-1.0, kind="double").collect()
        assert {(r.space, r.scale, r.i, r.j, r.k) for r in got} == set(wanted) and len(got) == len(wanted)
        for scale in (0.5, 1.5):
            for name in fields.COMPONENTS:
                want = np.fft.ifftn(np.fft.fftn(v) * k[int(name[1])] * k[int(name[2])] / np.where(k2 > 0, k2, 1) * np.exp(-k2 * scale**2 / 2)).real
                assert all(abs(r[name] - want[r.i, r.j, r.k]) < 1e-10 for r in got if r.scale == scale)


def test_smoothing_of_sparse_cells_equals_numpy(spark):
    for n in (6, 7):
        v, delta, sides, k = _sparse(spark, n, 10.0)
        want = np.fft.ifftn(np.fft.fftn(v) * np.exp(-(k**2).sum(axis=0) * 1.5**2 / 2)).real
        got = fields.smoothed(delta, sides, n, 1.5, empty=-1.0, digits=6).collect()
        assert len(got) == 2 * n**3 and all(abs(r.v - want[r.i, r.j, r.k]) < 6e-7 and r.v == round(r.v, 6) for r in got)


def test_tensors_of_whole_cubes_equal_numpy(spark, monkeypatch):
    # six scales are two tasks a cube; the last time the cube is too large for a task
    scales = [None, 0.3, 0.5, 1.0, 1.5, 2.5]
    for n, cube in ((6, 256), (7, 256), (8, 256), (6, 4)):
        monkeypatch.setattr(fields, "CUBE", cube)
        v, delta, sides, k = _sparse(spark, n, 10.0)
        k2 = (k**2).sum(axis=0)
        tensors = fields.tidal_tensors(delta, sides, n, scales, kind="double", empty=-1.0, digits=4)
        got = tensors.collect()
        assert len(got) == len({(r.space, r.scale, r.i, r.j, r.k) for r in got}) == 2 * len(scales) * n**3
        for scale in scales:
            for name in fields.COMPONENTS:
                want = np.fft.ifftn(np.fft.fftn(v) * k[int(name[1])] * k[int(name[2])] / np.where(k2 > 0, k2, 1) * np.exp(-k2 * (scale or 0.0) ** 2 / 2)).real
                assert all(abs(r[name] - want[r.i, r.j, r.k]) < 5.1e-5 and r[name] == round(r[name], 4) for r in got if r.scale == (scale or 0.0))
        plan = tensors._jdf.queryExecution().executedPlan().toString()
        assert ("collect_list" in plan) == (n > cube)  # cells are regrouped along the axes only where no task holds the cube


def test_the_cells_of_a_run_are_not_regrouped(spark, tmp_path):
    tables(spark, tmp_path)
    plan = q.QUERIES["m9_tidal_tensor_run_grid"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_a_cell_that_is_nan_spoils_its_cube_alone(spark):
    delta = spark.createDataFrame([(1, 0, 0, 0, float("nan")), (1, 1, 1, 1, 2.0), (2, 1, 1, 1, 2.0)], "space int, i int, j int, k int, v double")
    got = fields.tidal_tensors(delta, spark.createDataFrame([(1, 10.0), (2, 10.0)], "space int, side double"), 4, [1.0], kind="double").collect()
    assert {(r.space, np.isnan(r.t01)) for r in got} == {(1, True), (2, False)} and len(got) == 2 * 4**3


def _regroups_cells(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"hashpartitioning\(space#\d+, i#\d+, j#\d+, k#\d+", plan) is not None


def test_a_whole_overdensity_shuffles_points_and_not_their_cells(spark, tmp_path, monkeypatch):
    # blocks of two planes of the first grid, of one plane of the second
    monkeypatch.setattr(grid, "BLOCK", 40)
    want = overdensities(tables(spark, tmp_path))
    delta = q.QUERIES["a4_overdensity_run_grid"](spark, str(tmp_path))
    got = delta.collect()
    assert len(got) == len({(r.space, r.i, r.j, r.k) for r in got}) == 4**3 + 6**3
    assert all(abs(r.delta - want[r.space][r.i, r.j, r.k]) < 6e-7 and r.delta == round(r.delta, 6) for r in got)
    assert not _regroups_cells(delta)


def test_points_without_a_place_are_no_part_of_an_overdensity(spark):
    rows = [(1, 8.0, 7.5, 0.5, 0.5), (1, 8.0, None, 0.5, 0.5), (1, 8.0, 1.0, float("nan"), 1.0), (None, 8.0, 1.0, 1.0, 1.0), (2, 0.0, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "box int, side double, x double, y double, z double")
    got = {(r.space, r.i, r.j, r.k): r.v for r in grid.full_overdensity(points, 8, 6).collect()}
    assert len(got) == 8**3 and got[1, 7, 0, 0] == got[1, 0, 1, 1] == 8**3 / 8 - 1 and sum(v != -1 for v in got.values()) == 8
    assert grid.full_overdensity(points.limit(0), 8, 6).count() == 0


def test_smoothing_of_points_shuffles_them_and_not_their_cells(spark, tmp_path, monkeypatch):
    want = overdensities(tables(spark, tmp_path))
    for cube in (256, 4):  # the last time the second grid is too large for a task
        monkeypatch.setattr(fields, "CUBE", cube)
        smooth = q.QUERIES["m8_smoothed_run_grid"](spark, str(tmp_path))
        got = smooth.collect()
        assert len(got) == len({(r.space, r.i, r.j, r.k) for r in got}) == 4**3 + 6**3
        for run, (n, side) in GRIDS.items():
            k = 2 * np.pi * np.fft.fftfreq(n, side / n)
            window = np.exp(-(k[:, None, None] ** 2 + k[:, None] ** 2 + k**2) * 10.0**2 / 2)
            expected = np.fft.ifftn(np.fft.fftn(want[run]) * window).real
            assert all(abs(r.delta - expected[r.i, r.j, r.k]) < 6e-7 for r in got if r.space == run)
        assert _regroups_cells(smooth) == (cube == 4)


def test_tensors_of_points_shuffle_them_and_not_their_cells(spark, tmp_path, monkeypatch):
    want = overdensities(tables(spark, tmp_path))
    n, side = GRIDS[2]
    k = 2 * np.pi * np.fft.fftfreq(n, side / n)
    k = np.stack(np.meshgrid(k, k, k, indexing="ij"))
    k2 = (k**2).sum(axis=0)
    halos = q.high(spark, str(tmp_path)).where("run_id = 2")
    scales = [None, 0.3, 0.5, 1.0, 1.5, 2.5]
    for cube in (256, 4):  # the last time the cube is too large for a task
        monkeypatch.setattr(fields, "CUBE", cube)
        tensors = fields.tidal_tensors_of_points(halos, q.box_sides(halos), n, scales, digits=4)
        got = tensors.collect()
        assert len(got) == len({(r.space, r.scale, r.i, r.j, r.k) for r in got}) == len(scales) * n**3
        for scale in scales:
            for name in fields.COMPONENTS:
                expected = np.fft.ifftn(np.fft.fftn(want[2]) * k[int(name[1])] * k[int(name[2])] / np.where(k2 > 0, k2, 1) * np.exp(-k2 * (scale or 0.0) ** 2 / 2)).real
                assert all(abs(r[name] - expected[r.i, r.j, r.k]) < 5.1e-5 for r in got if r.scale == (scale or 0.0))
        if cube == 256:
            assert not _regroups_cells(tensors)
    monkeypatch.undo()
    assert not _regroups_cells(q.QUERIES["m9_tidal_tensor_run_grid"](spark, str(tmp_path)))
