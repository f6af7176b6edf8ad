import random

from skylattice.operators import hierarchy as module
from skylattice.operators.hierarchy import descendants, hierarchy, sent_descendants


def brute(parent):
    out = {}
    for node in parent:
        path, at = [node], node
        while True:
            up = parent[at]
            if up is None or up == -1 or up not in parent:
                out[node] = (at, len(path) - 1, path[::-1])
                break
            if up in path:
                loop = path[path.index(up) :]
                out[node] = (min(loop), -1, None)
                break
            path.append(up)
            at = up
    return out


def rows_of(spark, parent, **kw):
    df = spark.createDataFrame([(k, v, "x") for k, v in parent.items()], "halo_id long, pid long, root_id string")
    tree = hierarchy(df, "halo_id", "pid", **kw)
    return tree, {r.id: (r.root_id, r.depth, r.path) for r in tree.collect()}


def test_random_forests_with_loops_and_chains(spark):
    rng = random.Random(3)
    parent = {k: rng.choice([-1, None, 999, *range(40)]) for k in range(40)} | {100 + k: 101 + k for k in range(25)} | {200 + k: 0 for k in range(30)}
    parent[125] = -1
    want = brute(parent)
    tree, got = rows_of(spark, parent)
    assert got == want
    below = {}
    for node, (_, depth, path) in want.items():
        for k, a in enumerate(path or []):
            if a != node:
                below[(a, node)] = depth - k
    assert {(r.ancestor_id, r.descendant_id): r.distance for r in descendants(tree).collect()} == below
    sizes = {r.id: r.size for r in tree.collect() if r.depth >= 0}
    assert sizes == {n: 1 + sum(a == n for a, _ in below) for n in sizes}


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 1), (3, 3), (4, 3)], "halo_id long, pid long")
    got = {r.id: (r.root_id, r.depth, r.on_loop) for r in hierarchy(df, "halo_id", "pid", paths=False).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (3, -1, True), 4: (3, -1, False)}
    assert hierarchy(df.limit(0), "halo_id", "pid").count() == 0


def test_trees_below_loops_keep_their_descendants(spark, tmp_path):
    from skylattice.plans import pipeline_queries as q

    rng = random.Random(8)
    parent = {1: 2, 2: 3, 3: 1, 10: 1, 11: 10, 12: 11, 13: 10, 20: 20, 21: 20, 30: -1, 31: 30} | {100 + k: rng.choice([2, 11, 21, 31, *range(100, 100 + max(k, 1))]) if k else 2 for k in range(40)}
    on_loop = {1, 2, 3, 20}
    below = {}
    for node in parent:
        at, steps = parent[node], 1
        while node not in on_loop and at in parent and at not in on_loop:
            below[(at, node)] = steps
            at, steps = parent[at], steps + 1
    spark.createDataFrame(list(parent.items()), "halo_id long, pid long").write.parquet(f"{tmp_path}/hr_halos.parquet")
    for query in (q.p2_all_descendants, q.p2_descendants):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == len(below) and {(r.ancestor_id, r.descendant_id): r.distance for r in rows} == below
    got = {r.halo_id: r for r in q.p2_whole_hierarchy(spark, str(tmp_path)).collect()}
    assert {k: r.n_descendants for k, r in got.items()} == {k: None if k in on_loop else sum(a == k for a, _ in below) for k in parent}
    assert got[12].hang == "10/11/12" and got[12].path is None and got[12].root_id == 1 and got[1].hang is None and got[31].hang is None and got[31].path == "30/31"
    assert {k for k, r in got.items() if r.on_loop} == on_loop


def test_lists_are_sent_in_pieces_and_through_long_chains(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 7)
    # one parent of a third of the rows below a chain, and a second tree
    parent = {k: k - 1 for k in range(1, 40)} | {0: -1} | {100 + k: 20 for k in range(30)} | {200: None} | {201 + k: 200 + k // 3 for k in range(20)}
    df = spark.createDataFrame([(k, v) for k, v in parent.items()], "halo_id long, pid long")
    below = {}
    for node in parent:
        at, steps = parent[node], 1
        while at in parent:
            below[(at, node)] = steps
            at, steps = parent[at], steps + 1
    rows = sent_descendants(df, "halo_id", "pid").collect()
    assert len(rows) == len(below) and {(r.ancestor_id, r.descendant_id): r.distance for r in rows} == below
    assert sent_descendants(df.limit(0), "halo_id", "pid").count() == 0
