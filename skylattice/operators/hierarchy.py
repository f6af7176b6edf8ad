"""Parent-child rows to full hierarchies, by bottom-up leaf peeling.

A node is peeled as soon as all its children are peeled; on being peeled it
sends its subtree size to its parent. Several peel rounds share one job: a
round is one ``groupBy`` over the remaining nodes and the messages to them, so
the plan stays a chain. What is never peeled lies on closed loops. In reverse
peel order every node then looks up its parent, which was peeled later, and
gets root, depth and path from it. Lists of descendants go up with the peel: a
node sends its list and itself to its parent. A list is a set of rows, dealt
into blocks by hash, so that the list of a root that holds a third of all rows
is sent and received in many pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import stage


@dataclass
class Peeled:
    """The stages of a peel: (rounds in the stage, its peeled nodes), and the loop nodes."""

    stages: list[tuple[int, DataFrame]]
    loops: DataFrame


def _nodes(df: DataFrame, node: str, parent: str, root_markers: tuple[int, ...]) -> DataFrame:
    child, up = F.col(node).cast("long"), F.col(parent).cast("long")
    named = F.when(~up.isin(*root_markers), up) if root_markers else up
    return df.select(child.alias("id"), named.alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))


# a node's own row and its message to the parent, as rows of one shape
_OWN = "named_struct('id', id, 'parent', parent, 'kids', kids, 'size', size, 'peel', {peel}, 'clock', clock + 1, 'own', true)"
_SENT = "named_struct('id', parent, 'parent', cast(null AS long), 'kids', {kids}, 'size', {size}, 'peel', cast(null AS int), 'clock', cast(null AS int), 'own', false)"


def _exchange(state: DataFrame, sends: str, peel: str, kids: str, size: str) -> DataFrame:
    """Add the messages to the node they name; messages to unknown nodes fall away.

    The clock is a column, so that all rounds share their compiled code.
    """
    own, sent = _OWN.format(peel=peel), _SENT.format(kids=kids, size=size)
    rows = state.selectExpr(f"inline(CASE WHEN {sends} THEN array({own}, {sent}) ELSE array({own}) END)")
    return rows.groupBy("id").agg(F.expr("max(parent) AS parent"), F.expr("sum(kids) AS kids"), F.expr("sum(size) AS size"), F.expr("max(peel) AS peel"), F.expr("max(clock) AS clock"), F.expr("max(own) AS own")).where("own")


def _count_children(nodes: DataFrame) -> DataFrame:
    start = nodes.selectExpr("id", "parent", "cast(0 AS long) AS kids", "cast(1 AS long) AS size", "cast(null AS int) AS peel", "-1 AS clock")
    return _exchange(start, "parent IS NOT NULL", "peel", "cast(1 AS long)", "cast(0 AS long)")


def _peel_round(state: DataFrame) -> DataFrame:
    """Peel the nodes without children left."""
    leaf = "(peel IS NULL AND kids = 0)"
    return _exchange(state, f"{leaf} AND parent IS NOT NULL", f"CASE WHEN {leaf} THEN clock + 1 ELSE peel END", "cast(-1 AS long)", "size")


def _loop_roots(loops: DataFrame) -> DataFrame:
    """(id, root_id): the smallest id of each closed loop, by pointer doubling."""
    ring = stage(loops.select("id", F.col("parent").alias("ahead"), F.col("id").alias("root_id")), "ring")
    while True:
        far = ring.select(F.col("id").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("root_id").alias("root2"))
        moved = ring.join(far, "ahead").select("id", F.col("ahead2").alias("ahead"), F.least("root_id", "root2").alias("root_id"), (F.col("root2") < F.col("root_id")).alias("changed"))
        moved = stage(moved, "ring")
        ring = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return ring.select("id", "root_id")


def peel(df: DataFrame, node: str, parent: str, root_markers: tuple[int, ...] = (-1,), rounds_per_stage: int = 8) -> Peeled:
    """Peel the forest of (node, parent) rows from its leaves.

    Null nodes are ignored, a null parent or a root marker names no parent, rows
    that repeat a node count once (with differing parents the smallest holds), a
    self reference is a loop, other columns are ignored.
    """
    state, stages, number, rounds = _count_children(_nodes(df, node, parent, root_markers)), [], 0, 1
    while True:
        for _ in range(rounds):
            number += 1
            state = _peel_round(state)
        done = stage(state, "peel")
        last = done.where(f"peel = {number}").isEmpty()
        stages.append((rounds, done.where("peel is not null").select("id", "parent", "peel", "size")))
        rest = done.where("peel is null")
        if last:
            return Peeled(stages, rest.select("id", "parent"))
        state, rounds = rest, min(rounds * 2, rounds_per_stage)


def _resolve(block: DataFrame, hops: int, resolved: DataFrame, paths: bool) -> DataFrame:
    """Walk each node of a block up until it meets a resolved node, a root or an unknown parent.

    Every step leads to a node peeled in a later round, so ``hops`` lookups leave the block.
    """
    none = "cast(null AS array<long>)"
    path = lambda text: text if paths else none
    known = block.selectExpr("id AS key", "parent AS up", "cast(null AS long) AS r_root", "cast(null AS int) AS r_depth", f"{none} AS r_path", "true AS live", "true AS hit")
    known = known.union(resolved.selectExpr("id", "cast(null AS long)", "root_id", "depth", path("path"), "true", "true"))
    walk = block.selectExpr("id", "parent", "peel", "size", "id AS at", "parent AS next", "0 AS steps", "cast(null AS long) AS root_id", "cast(null AS int) AS depth", f"{none} AS path", f"{path('array(id)')} AS passed")
    walking = "(depth IS NULL AND next IS NOT NULL)"
    step = "(hit AND r_depth IS NULL)"
    for _ in range(hops):
        # a row that has ended is keyed by its own id, which spreads evenly, and matches nothing
        walk = walk.selectExpr("*", f"{walking} AS live", f"CASE WHEN {walking} THEN next ELSE id END AS key").join(known, ["key", "live"], "left")
        walk = walk.selectExpr(
            "id", "parent", "peel", "size", f"CASE WHEN {step} THEN key ELSE at END AS at", f"CASE WHEN {step} THEN up END AS next", f"CASE WHEN {step} THEN steps + 1 ELSE steps END AS steps",
            "coalesce(root_id, r_root) AS root_id", "CASE WHEN r_depth < 0 THEN -1 WHEN r_depth IS NOT NULL THEN r_depth + steps + 1 ELSE depth END AS depth",
            path("CASE WHEN r_depth IS NOT NULL THEN concat(r_path, reverse(passed)) ELSE path END") + " AS path", path(f"CASE WHEN {step} THEN concat(passed, array(key)) ELSE passed END") + " AS passed",
        )
    ended = "CASE WHEN depth IS NULL THEN"
    return walk.selectExpr("id", "parent", "peel", "size", f"{ended} at ELSE root_id END AS root_id", f"{ended} steps ELSE depth END AS depth", path(f"{ended} reverse(passed) ELSE path END") + " AS path")


def hierarchy(df: DataFrame, node: str, parent: str, root_markers: tuple[int, ...] = (-1,), paths: bool = True, rounds_per_stage: int = 8) -> DataFrame:
    """(id, parent, root_id, depth, path, size, on_loop, hang): one row for each node.

    depth is 0 at a root, which is a node whose parent is null, a root marker or
    not in the table; path runs from the root to the node; size counts the node
    and all its descendants. Nodes on a closed loop and below one have depth -1,
    the smallest id of the loop as root_id and a null path; size is null on the
    loop. hang is, for nodes below a loop only, the path to the node from the one
    whose parent is on the loop. Input cases as in :func:`peel`; an empty table gives an empty result.
    """
    peeled = peel(df, node, parent, root_markers, rounds_per_stage)
    loops = peeled.loops
    columns = ("id", "parent", "root_id", "depth", "path", "size", "on_loop")
    # an empty path on the loop, so that paths below it begin at the node that hangs on it
    start = f"cast({'array()' if paths else 'null'} AS array<long>)"
    if loops.isEmpty():
        resolved = loops.selectExpr("id", "parent", "id AS root_id", "-1 AS depth", f"{start} AS path", "cast(null AS long) AS size", "true AS on_loop")
    else:
        resolved = loops.join(_loop_roots(loops), "id").selectExpr("id", "parent", "root_id", "-1 AS depth", f"{start} AS path", "cast(null AS long) AS size", "true AS on_loop")
        resolved = stage(resolved, "loops")
    for k, (rounds, block) in reversed(list(enumerate(peeled.stages))):
        done = _resolve(block, rounds, resolved, paths).withColumn("on_loop", F.lit(False)).select(*columns)
        if k:  # later blocks look these up; the first block holds the leaves, which nobody looks up
            done = stage(done, "resolved")
        resolved = resolved.select(*columns).unionByName(done)
    return resolved.select(*[F.when(F.col("depth") >= 0, F.col(c)).alias(c) if c == "path" else c for c in columns], F.when((F.col("depth") < 0) & ~F.col("on_loop"), F.col("path")).alias("hang"))


#: descendants in one piece of a list, about
PIECE = 100_000


def sent_descendants(df: DataFrame, node: str, parent: str, root_markers: tuple[int, ...] = (-1,), rounds_per_stage: int = 8) -> DataFrame:
    """(ancestor_id, descendant_id, distance): all descendants of each node, from the lists that the peel sends upwards.

    Every node sends its list, and itself, to its parent as soon as it is peeled;
    the nodes of one stage of the peel are at most its rounds apart, so that at most
    so many steps pass the lists through it. Lists to a node on a closed loop or not in
    the table fall away, so nodes on a loop have no rows, and the trees that hang
    on a loop have theirs. Input cases as in :func:`peel`.
    """
    peeled = peel(df, node, parent, root_markers, rounds_per_stage)
    whole = peeled.stages[0][1]
    for _, nodes in peeled.stages[1:]:
        whole = whole.unionByName(nodes)
    pieces = (F.col("size") / PIECE).cast("long") + 1
    known = stage(whole.select(F.col("id").alias("parent"), pieces.alias("parent_pieces")), "known")
    pairs = None
    for rounds, nodes in peeled.stages:
        links = nodes.join(known, "parent").select(F.col("id").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"), "parent", "parent_pieces")
        links = stage(links, "links")
        # the nodes of this stage, each with itself, and what earlier stages sent to them
        own = F.pmod(F.xxhash64("id"), pieces).alias("piece")
        lists = nodes.select(F.col("id").alias("at"), F.col("id").alias("descendant_id"), F.lit(0).alias("distance"), own)
        if pairs is not None:
            lists = lists.unionByName(pairs)
        # a table for each step keeps the plans small
        for _ in range(rounds):
            piece = F.pmod(F.xxhash64("descendant_id"), F.col("parent_pieces")).alias("piece")
            lists = stage(lists.join(links, ["at", "piece"]).select(F.col("parent").alias("at"), "descendant_id", (F.col("distance") + 1).alias("distance"), piece), "passed")
            pairs = lists if pairs is None else pairs.unionByName(lists)
            if lists.isEmpty():
                break
    return pairs.select(F.col("at").alias("ancestor_id"), "descendant_id", F.col("distance").cast("int").alias("distance"))


def descendants(tree: DataFrame, below_loops: bool = False) -> DataFrame:
    """(ancestor_id, descendant_id, distance): all descendants of each node of :func:`hierarchy`.

    One row for each pair, not one list for each ancestor: the list of a root may
    hold a third of all rows. Nodes on a loop have no rows. The trees that hang
    on a loop have theirs with ``below_loops``, else none.
    """
    path = F.coalesce("path", "hang") if below_loops else F.col("path")
    rows = tree.select(F.col("id").alias("descendant_id"), path.alias("path")).where(F.size("path") > 1)
    rows = rows.select("descendant_id", (F.size("path") - 1).alias("depth"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "ancestor_id"))
    return rows.select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
