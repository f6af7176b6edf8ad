import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import conditional
from skylattice.operators.calibration import Calibration, calibrate, fit_model
from skylattice.plans.config import Bias, MassFilter, Settings, from_dict
from skylattice.sources import bigfile, catalogs, sinks
from skylattice.streaming import incremental


def table(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    logm, env = rng.uniform(11, 13, n), rng.normal(size=n)
    cv, spin = np.exp(0.3 * env + 0.1 * rng.normal(size=n)) * 8, rng.lognormal(-3.5, 0.5, n)
    ca = rng.uniform(0.2, 0.7, n)
    ba = ca + (1 - ca) * rng.uniform(0, 1, n)
    rows = [(first + k, *map(float, v)) for k, v in enumerate(zip(10**logm, env, cv, spin, ca, ba))]
    return spark.createDataFrame(rows, "id long, m200b double, env double, cv double, spin double, ca double, ba double")


def test_conditional_model(spark):
    props = ["cv", "spin", "ca", "ba"]
    train, target = table(spark, 600, 1), table(spark, 200, 2, 1000).select("id", "m200b", "env")
    out = conditional.enrich(target, train, [11.0, 12.0, 13.0], ["env"], props, "id", min_rows=50).toPandas()
    assert len(out) == 200 and out.cv.notna().all() and out.constraint_ok.mean() > 0.95
    assert np.corrcoef(out.env, np.log(out.cv))[0, 1] > 0.8
    again = conditional.enrich(target.repartition(7), train, [11.0, 12.0, 13.0], ["env"], props, "id", min_rows=50).toPandas()
    assert np.allclose(out.sort_values("id").cv, again.sort_values("id").cv)
    held = conditional.hold_out(train, [11.0, 13.0], ["env"], props, "id").toPandas()
    assert 60 < len(held) < 180 and np.corrcoef(np.log(held.cv), np.log(held.true_cv))[0, 1] > 0.7
    assert conditional.fit(conditional.with_bin(train.limit(10), [11.0, 13.0]), ["env"], props) == {}
    models = conditional.fit(conditional.with_bin(train, [11.0, 13.0]), ["env"], props, exact=True)
    assert conditional.from_json(conditional.to_json(models)) == models


def pair(spark):
    schema = "id long, run_id int, box int, side double, r_match double, max_mass_distance double, x double, y double, z double, m200b double"
    rng = np.random.default_rng(0)
    rows = [(k, 1, 1, 100.0, 2.0, 0.95, *map(float, rng.uniform(0, 100, 3)), float(10 ** rng.uniform(11, 13))) for k in range(60)]
    low = [(k, 1, 1, 100.0, 2.0, 0.95, r[6] + 0.2, r[7], r[8], r[9] * 0.9) for k, r in enumerate(rows)] + [(100, 1, 1, 100.0, 2.0, 0.95, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(low, schema)


def test_calibration(spark):
    high, low = pair(spark)
    for method in ("off", "abundance", "matching", "matching_ml"):
        got = calibrate(low, high, Calibration(method, trees=5, depth=3)).toPandas().set_index("id")
        assert len(got) == 61 and set(got.mass_calib_method) == {method}
        if method == "matching":
            hr = high.toPandas().set_index("id")
            ok = got[got.matched]
            assert len(ok) > 50 and np.allclose(ok.m200b_cal, hr.m200b.loc[ok.hr_id.astype(int)])
        if method == "abundance":
            known = got.dropna(subset=["m200b_cal"]).sort_values("m200b")
            assert (np.diff(known.m200b_cal) >= 0).all()
    with pytest.raises(ValueError):
        Calibration("none of these")
    with pytest.raises(ValueError):
        calibrate(low.withColumn("x", F.col("x") + 50), high, Calibration("matching"))
    assert len(Calibration().fingerprint()) == 16 and Calibration().fingerprint() != Calibration(k=3).fingerprint()


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    high, low = pair(spark)
    mass, _ = fit_model(low, high, Calibration("matching_ml", trees=5, depth=3))
    mass.write().overwrite().save(str(tmp_path / "m"))
    rows = low.where("m200b IS NOT NULL").withColumn("log10_m200b", F.log10("m200b"))
    a, b = (m.transform(rows).select("_log_mass").toPandas() for m in (mass, PipelineModel.load(str(tmp_path / "m"))))
    assert np.allclose(a, b)


def test_settings():
    s = from_dict(Settings, {"calibration": {"method": "matching", "k": 12, "unknown": 1}, "mass_filter": {"low": 1e11, "high": 5e12}, "features": ["env"]})
    assert s.calibration.k == 12 and s.calibration.trees == 50 and s.features == ("env",)
    for bad in (lambda: MassFilter(3, 2), lambda: Bias(enabled=False, only=True), lambda: from_dict(Settings, {"calibration": {"method": "x"}}), lambda: Settings().edges(None)):
        with pytest.raises(ValueError):
            bad()
    assert Settings(n_bins=2).edges(13.0) == [9.0, 11.0, 13.0]


def test_text_catalogues(spark, tmp_path):
    row = lambda i, pid: " ".join(str(v) for v in [1, i, *[0] * 3, pid, *[1] * 11, 1.5, 2.5, 3.5, *[7] * 17, 2, 0, 1e12, *[0.5] * 20])
    p = tmp_path / "h.list"
    p.write_text("#scale(0) id(1) desc(2) a(3) b(4) pid(5)\n#Om = 0.3089; Ol = 0.6911; h = 0.6774\n" + "\n".join([row(1, -1), row(2, 5), "", row(3, -1), "1 2 3"]) + "\n")
    header = catalogs.read_header(spark, str(p))
    assert header.cosmology() == {"om": 0.3089, "ol": 0.6911, "h": 0.6774} and header.pid_column() == 5
    got = catalogs.halo_catalog(spark, str(p), "hlist", hosts=True)
    assert sorted(r.id for r in got.collect()) == [1, 3] and got.first().x == 1.5
    assert catalogs.halo_catalog(spark, str(p), "hlist", hosts=False, limit=2).count() == 2
    assert catalogs.Header(["#ID x y"], 3).pid_column() is None
    with pytest.raises(ValueError):
        catalogs.host_filter(catalogs.Header(["#ID x y"], 3), True)
    named = "#ID " + " ".join("PID" if k == 45 else f"c{k}" for k in range(50))
    assert catalogs.Header([named], 41).pid_column() == 40 and catalogs.Header([named], 60).pid_column() == 46
    assert catalogs.Header(["#omega matter = 0.3; Omega_Lambda0 = 0.7; H0 = 0.7"]).cosmology() == {"om": 0.3, "ol": 0.7, "h": 0.7}
    with pytest.warns(UserWarning, match="column 5"):
        assert catalogs.host_filter(catalogs.Header(["# no names"], 60), True, 5) == 5
    assert catalogs.host_filter(catalogs.Header(["# no names"], 60), None, 5) is None
    late = tmp_path / "late.list"
    late.write_text("\n".join(["# a comment"] * 300) + "\n#ID X Y Z M200b PID\n#Omega_M = 0.3; Omega_L = 0.7; h = 0.7\n1 2 3 4 1e12 -1\n2 2 3 4 1e12 1\n")
    header = catalogs.read_header(spark, str(late))
    assert header.pid_column() == 5 and len(header.lines) == 302 and header.cosmology()["om"] == 0.3
    columns = {"id": 0, "x": 1, "y": 2, "z": 3, "m200b": 4}
    assert [r.id for r in catalogs.halo_catalog(spark, str(late), columns).collect()] == [1]
    assert catalogs.Header(["#Omega_M = 0.3; Omega_L = 0.7; h0 = 0.7"]).cosmology() == {"om": 0.3, "ol": 0.7, "h": 0.7}
    q = tmp_path / "p.txt"
    q.write_text("1 2 3 9\n\n4 5 6\n# c\n7 8\n")
    assert sorted(tuple(r) for r in catalogs.particles(spark, str(q)).collect()) == [(1, 2, 3), (4, 5, 6)]
    d = tmp_path / "d"
    d.mkdir()
    for k in (0, 2, 10):
        (d / f"{k}_halo_environment_descriptors.txt").write_text(f"# h\n{k}.0 1.0 2.0 3.0 1e11 0.2 0.3 0.4\n")
    (d / "halo_environment_descriptors.txt").write_text("99 1 2 3 1 1 1 1\n")
    assert sorted(r.descriptor_halo_id for r in catalogs.descriptor_table(spark, str(d)).collect()) == [0, 2, 10]
    assert sorted(r.batch_id for r in catalogs.descriptor_table(spark, str(d), 2).collect()) == [0, 2]


def test_column_blocks(spark, tmp_path):
    def block(path, values, per_file):
        path.mkdir(parents=True)
        parts = [values[k : k + per_file] for k in range(0, len(values), per_file)]
        members = values.shape[1] if values.ndim > 1 else 1
        (path / "header").write_text(f"DTYPE: {values.dtype.str}\nNMEMB: {members}\nNFILE: {len(parts)}\n" + "".join(f"{k:06X}: {len(v)} : 0 : 0\n" for k, v in enumerate(parts)))
        for k, v in enumerate(parts):
            v.tofile(path / f"{k:06X}")

    xyz = np.arange(15, dtype="<f8").reshape(5, 3)
    block(tmp_path / "Position", xyz, 2)
    block(tmp_path / "ID", np.arange(5, dtype="<i8"), 2)
    block(tmp_path / "Length", np.array([10, 20, 30, 40, 50], dtype="<i4"), 3)
    (tmp_path / "Header").mkdir()
    (tmp_path / "Header" / "attr-v2").write_text("".join(f"{n} <f8 1 {np.float64(v).tobytes().hex()} #HUMANE\n" for n, v in (("UnitMass_in_g", 1.989e33), ("HubbleParam", 0.7))))
    got = bigfile.linked_halos(spark, str(tmp_path), rows_per_partition=2).orderBy("row_id").collect()
    assert [r.id for r in got] == list(range(5)) and [(r.x, r.y, r.z) for r in got] == [tuple(v) for v in xyz]
    assert got[0].m200b == pytest.approx(14.2857, rel=1e-4)
    assert bigfile.blocks(spark, str(tmp_path), "Position:x/y/z", 2).rdd.getNumPartitions() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2, 3, 1e11, 0.2, 0.5, None)], "descriptor_halo_id long, cell_x int, cell_y int, cell_z int, descriptor_m200b double, halo_rg double, tidal_anisotropy double, overdensity double")
    sinks.write_descriptors(df, str(tmp_path / "t"), mass=False)
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert any(line.startswith("# descriptor_halo_id") for line in lines) and "1 1 2 3 0.2 0.5 nan" in lines
    with pytest.raises(ValueError):
        sinks.write_descriptors(df.drop("cell_x"), str(tmp_path / "u"))
    sinks.write_grid(spark.createDataFrame([(0, 0, 0, 1.5)], "i int, j int, k int, v double"), str(tmp_path / "g"), {"box_size": 10, "n_grid": 3, "n_particles": 6, "mass_particle": 1.2e9})
    grid, info = sinks.read_grid(spark, str(tmp_path / "g"))
    assert grid.first().v == 1.5 and info["n_particles"] == 6
    pts = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 60.0, 1.0, 1.0)], "id long, x double, y double, z double")
    assert sinks.spatial_sample(pts, (0, 0, 0), (50, 50, 50), str(tmp_path / "s"), "a", str(tmp_path / "m.json")).count() == 1
    assert catalogs.read_settings(str(tmp_path / "m.json"))["a"]["rows"] == 1
    assert sinks.recentred_copy(pts, (1.0, 0, 0), str(tmp_path / "r")).orderBy("id").first().x == 0.0
    assert sinks.grid_name("/a/b/1") == "b" and sinks.grid_name("/a/b/c.txt") == "c"
    assert sinks.box_header("#Box size: 100.0 Mpc/h", 50.0) == "#Box size: 50 Mpc/h"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1 2 3\n4 5 6\n")
    stream = incremental.particle_stream(spark, str(src))
    incremental.append_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    (src / "b.txt").write_text("7 8 9\n")
    incremental.append_table(incremental.particle_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = incremental.deposit_stream(incremental.particle_stream(spark, str(src)), 3, 10.0).writeStream.format("memory").queryName("dep").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(v) FROM dep").first()[0] == pytest.approx(3.0)


def test_model_sizes_arrive_and_models_are_kept(spark, tmp_path):
    import numpy as np

    from skylattice.operators import calibration

    for kind in ("gradient_boosting", "random_forest", "extra_trees"):
        made = calibration.regressor(kind, "y", "p", calibration.Calibration("matching_ml", regressor=kind, trees=60, depth=8))
        trees = made.getMaxIter() if kind == "gradient_boosting" else made.getNumTrees()
        assert (trees, made.getMaxDepth()) == (60, 8)
    rng = np.random.default_rng(0)
    xyz, mass = rng.uniform(0, 50, (60, 3)), 10 ** rng.uniform(11, 13, 60)
    rows = [(k, 1, 1, *map(float, xyz[k]), float(mass[k]), 50.0, 2.0) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, run_id int, box int, x double, y double, z double, m200b double, side double, r_match double").withColumn("max_mass_distance", F.lit(0.9))
    settings = calibration.Calibration("matching_ml", trees=3, depth=2)
    path = str(tmp_path / "model")
    first = calibration.calibrate(df, df, settings, model_path=path).select("id", "m200b_cal").orderBy("id").collect()
    again = calibration.calibrate(df, df.limit(0), settings, model_path=path).select("id", "m200b_cal").orderBy("id").collect()
    assert first == again
    with pytest.raises(ValueError, match="other settings"):
        calibration.load_model(path, calibration.Calibration("matching_ml", trees=4, depth=2), spark)
