import numpy as np

from skylattice.llm import linkage


def catalogues(spark, n=500, seed=0, side=60.0):
    rng = np.random.default_rng(seed)
    xyz, mass, spin = rng.uniform(0, side, (n, 3)), 10 ** rng.normal(11, 0.4, n), np.exp(rng.normal(-3.3, 0.5, n))
    high = [(k, 1, 1, *map(float, xyz[k]), float(mass[k]), float(spin[k])) for k in range(n)]
    low = []
    for k in range(n):
        if k % 5:
            p = xyz[k] + rng.normal(0, 0.25, 3)
            low.append((1000 + k, 1, 1, *map(float, p), float(mass[k] * 10 ** rng.normal(-0.03, 0.07)) if k % 11 else None, float(spin[k] * np.exp(rng.normal(0, 0.12))) if k % 7 else float("nan")))
    low += [(9000 + k, 1, 1, *map(float, rng.uniform(0, side, 3)), float(10 ** rng.normal(11, 0.4)), 0.04) for k in range(60)]
    low += low[:20] + [(8000, 1, 1, None, 1.0, 1.0, 1e11, 0.1), (8001, 1, 1, float("nan"), 1.0, 1.0, 1e11, 0.1), (8002, 77, 1, 1.0, 1.0, 1.0, 1e11, 0.1)]
    schema = "{} long, run_id int, box_id int, halo_x double, halo_y double, halo_z double, m200b double, spin double"
    runs = spark.createDataFrame([(1, side, 5.0, 0.95)], "run_id int, boxsize_mpc_h double, r_match_mpc_h double, max_mass_distance double")
    a = linkage.prepared(spark.createDataFrame(high, schema.format("halo_id")), "halo_id", runs)
    b = linkage.prepared(spark.createDataFrame(low, schema.format("lr_halo_id")), "lr_halo_id", runs)
    return a, b, {(k, 1000 + k) for k in range(n) if k % 5}


def test_planted_pairs(spark):
    high, low, truth = catalogues(spark)
    every = linkage.match(high, low).collect()
    assert min(r.confidence for r in every) < 0.5  # doubtful pairs stay
    rows = [r for r in every if r.confidence >= 0.5]
    got = {(r.hr, r.lr) for r in rows}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    assert all(0.5 <= r.confidence <= 1 and r.d < 5 for r in rows)
    right = [r.confidence for r in rows if (r.hr, r.lr) in truth]
    assert np.mean(right) > 0.9


def scores(high, low, side):
    """BM25 of all pairs within radius and mass distance, by brute force."""
    h, l = high.toPandas(), low.toPandas()
    r = 5.0
    steps = int(side * linkage.STEPS / (r * linkage.REACH["x"]))
    term, middle = {}, {}
    for a in "xyz":
        term[a] = np.minimum((h[a] / side * steps).astype(int), steps - 1).to_numpy(dtype=float)
        middle[a] = (term[a] + 0.5) * side / steps
    for a in ("lm", "ls"):
        term[a] = np.floor(h[a].to_numpy(dtype=float) * linkage.STEPS / linkage.REACH[a])
        middle[a] = (term[a] + 0.5) * linkage.REACH[a] / linkage.STEPS
    n = len(h)
    known = sum(~np.isnan(t) for t in term.values())
    norm = 2.2 / (1 + 1.2 * (0.25 + 0.75 * known / known.mean()))
    found = {}
    for k in range(n):
        impact = {}
        for a, t in term.items():
            away = np.abs(t - t[k])
            df = (np.minimum(away, steps - away) <= linkage.BESIDE).sum() if a in "xyz" else (away <= linkage.BESIDE).sum()
            impact[a] = np.log(1 + (n - df + 0.5) / (df + 0.5)) * norm[k]
        for _, q in l.iterrows():
            delta = {a: q[a] - h[a][k] for a in "xyz"}
            d = np.sqrt(sum((v - side * np.rint(v / side)) ** 2 for v in delta.values()))
            if d >= r or abs(q.mass - h.mass[k]) / h.mass[k] >= 0.95:
                continue
            s = 0.0
            for a in term:
                u = q[a] - middle[a][k]
                u = (u - side * np.rint(u / side)) / (r * 0.3) if a in "xyz" else u / linkage.REACH[a]
                s += impact[a] * max(0.0, 1 - u * u) if u == u else 0.0
            if s > 0:
                found[int(h.id[k]), int(q.id)] = s
    return found


def test_scores_and_lists_against_brute_force(spark, monkeypatch):
    # a small dense box, so that cells are narrower than the radius and far lists are walked or left out
    monkeypatch.setattr(linkage, "LIST_HALOS", 4)
    high, low, _ = catalogues(spark, 400, 3, side=14.0)
    low = low.where("id < 1060 OR id >= 9040")
    index = linkage.stage(linkage.indexed(high), "index")
    assert index.select("cells").first().cells > 14 / 5 / 2
    want = scores(high, low, 14.0)
    whole = {(r.hr, r.lr): r.bm25 for r in linkage.retrieved(index, low, None).collect()}
    assert set(whole) == set(want) and all(abs(whole[k] - want[k]) < 1e-4 for k in want)
    for top in (1, 3):
        rows = linkage.retrieved(index, low, top).collect()
        best = {}
        for (a, b), s in sorted(whole.items(), key=lambda x: (-x[1], x[0])):
            best.setdefault(b, []).append(a)
        assert {(r.hr, r.lr) for r in rows} == {(a, b) for b, found in best.items() for a in found[:top]}
        assert all(r.cut == (len(best[r.lr]) >= top) for r in rows)


def test_short_lists_give_the_same_matches(spark):
    high, low, _ = catalogues(spark, 250, 4, side=12.0)
    index = linkage.stage(linkage.indexed(high), "index")
    got = [{(r.hr, r.lr) for r in linkage.one_to_one(index, low, top).collect()} for top in (1, 4, 1000)]
    assert got[0] == got[1] == got[2]


def test_without_weights_nothing_is_found(spark, monkeypatch):
    high, low, _ = catalogues(spark, 100)
    monkeypatch.setattr(linkage, "idf", lambda df, n: df * 0.0)
    assert linkage.match(high, low).count() == 0


def test_nothing_to_match(spark):
    high, low, _ = catalogues(spark, 30)
    assert linkage.match(high, low.limit(0)).count() == 0
    assert linkage.match(high.limit(0), low).count() == 0


def test_rounds_go_to_the_end(spark, tmp_path):
    from skylattice.llm import queries

    # a row of halos, high and low by turns, each nearer to the next than to the last: one pair a round, from the end
    m, x, at = 7, 5.0, []
    for k in range(2 * m):
        at.append(x)
        x += 2.0 - 0.05 * k
    schema = "{} long, run_id int, box_id int, halo_x double, halo_y double, halo_z double, m200b double, spin double"
    row = lambda id_, x: (id_, 1, 1, x, 5.0, 5.0, None, None)
    spark.createDataFrame([row(k, at[2 * k]) for k in range(m)], schema.format("halo_id")).write.parquet(f"{tmp_path}/hr_halos.parquet")
    spark.createDataFrame([row(100 + k, at[2 * k + 1]) for k in range(m)], schema.format("lr_halo_id")).write.parquet(f"{tmp_path}/lr_halos.parquet")
    runs = "run_id int, boxsize_mpc_h double, r_match_mpc_h double, max_mass_distance double"
    spark.createDataFrame([(1, 60.0, 5.0, 0.95)], runs).write.parquet(f"{tmp_path}/sim_runs.parquet")
    rows = queries.p5_confidence(spark, str(tmp_path)).collect()
    assert {(r.hr_halo_id, r.lr_halo_id) for r in rows} == {(k, 100 + k) for k in range(m)}
    assert all(0 <= r.confidence <= 1 for r in rows)
