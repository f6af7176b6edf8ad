"""Points in regions, and points near other points, by triangles and bounding volumes.

Polygons are cut into triangles by ear clipping. A region may be limited in a
third coordinate, so that a triangle stands for a prism. Space is cut into
tiles; each triangle goes to the tiles that it touches, each point to its own.
In a tile the triangles' boxes form a bounding-volume hierarchy that the points
descend together; the triangles reached are tested exactly. A point on an edge
shared by triangles of one region is found by both and counted once.

A disc around a point is the square around it, two triangles, followed by the
exact distance. Tiles that hold too much are split into blocks of points times
blocks of regions, so that no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import finite, stage

TRIANGLE = ("ax", "ay", "bx", "by", "cx", "cy")


def ear_clip(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Indices of the triangles of a simple polygon; degenerate corners are skipped.

    Fewer than three distinct corners or no area give no triangle.
    """
    cross = lambda o, a, b: (x[a] - x[o]) * (y[b] - y[o]) - (y[a] - y[o]) * (x[b] - x[o])
    ring = [k for k in range(len(x)) if (x[k], y[k]) != (x[k - 1], y[k - 1]) or len(x) == 1]
    if len(ring) < 3:
        return []
    if sum(x[a] * y[b] - x[b] * y[a] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
        ring.reverse()
    found = []
    while len(ring) > 2:
        size = len(ring)
        for k in range(size):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % size]
            turn = cross(a, b, c)
            if turn == 0:
                ring.pop(k)
                break
            inside = (p for p in ring if p not in (a, b, c) and (x[p], y[p]) not in ((x[a], y[a]), (x[b], y[b]), (x[c], y[c])))
            if turn > 0 and not any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in inside):
                found.append((a, b, c))
                ring.pop(k)
                break
        else:
            raise ValueError("the polygon is not simple")
    return found


def _cut(polygons: DataFrame, key: str, xs: str, ys: str) -> DataFrame:
    """(key, ax, ay, bx, by, cx, cy, error): the triangles of each polygon, or a row with the reason why it has none."""
    kind = polygons.schema[key].dataType.simpleString()

    def clip(batches):
        for batch in batches:
            rows = []
            for name, px, py in zip(batch[key], batch[xs], batch[ys], strict=True):
                error, found = None, []
                if px is None or py is None or len(px) != len(py):
                    error = "no corners"
                else:
                    px, py = np.asarray(px, dtype=float), np.asarray(py, dtype=float)
                    if not (np.isfinite(px).all() and np.isfinite(py).all()):
                        error = "a corner is not finite"
                    else:
                        try:
                            found = ear_clip(px, py)
                            error = None if found else "no area"
                        except ValueError as e:
                            error = str(e)
                rows += [(name, px[a], py[a], px[b], py[b], px[c], py[c], None) for a, b, c in found] if found else [(name, *[None] * 6, error)]
            yield pd.DataFrame(rows, columns=[key, *TRIANGLE, "error"], dtype=object)

    return polygons.where(F.col(key).isNotNull()).select(key, xs, ys).mapInPandas(clip, f"{key} {kind}, " + ", ".join(f"{c} double" for c in TRIANGLE) + ", error string")


def triangulate(polygons: DataFrame, key: str, xs: str = "xs", ys: str = "ys") -> DataFrame:
    """(key, ax, ay, bx, by, cx, cy): the triangles of each polygon, given as arrays of its corners.

    Polygons that :func:`polygon_errors` lists have none.
    """
    return _cut(polygons, key, xs, ys).where("error IS NULL").drop("error")


def polygon_errors(polygons: DataFrame, key: str, xs: str = "xs", ys: str = "ys") -> DataFrame:
    """(key, error): the polygons without triangles and why: no corners, a corner that is not finite, no area, or not simple."""
    return _cut(polygons, key, xs, ys).where("error IS NOT NULL").select(key, "error")


def _spread(v: np.ndarray) -> np.ndarray:
    """The low ten bits of each number, two zero bits before each."""
    v = v.astype(np.int64) & 0x3FF
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        v = (v | (v << shift)) & mask
    return v


class BoundingVolumes:
    """A binary hierarchy of boxes over given boxes, which are ordered along a space-filling curve."""

    LEAF = 8

    def __init__(self, low: np.ndarray, high: np.ndarray):
        mid = np.clip((low + high) / 2, -1e300, 1e300)
        span = np.ptp(mid, axis=0)
        grid = ((mid - mid.min(axis=0)) / np.where(span > 0, span, 1) * 1023).astype(np.int64)
        self.order = np.argsort(_spread(grid[:, 0]) << 2 | _spread(grid[:, 1]) << 1 | _spread(grid[:, 2]), kind="stable")
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, len(low) / self.LEAF)))))
        room = leaves * self.LEAF
        self.slots = np.full(room, -1)
        self.slots[: len(low)] = self.order
        lo, hi = np.full((room, 3), np.inf), np.full((room, 3), -np.inf)
        lo[: len(low)], hi[: len(low)] = low[self.order], high[self.order]
        self.levels = [(lo.reshape(leaves, self.LEAF, 3).min(axis=1), hi.reshape(leaves, self.LEAF, 3).max(axis=1))]
        while len(self.levels[0][0]) > 1:
            lo, hi = self.levels[0]
            self.levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))

    def candidates(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) index pairs of the boxes in the leaves that each point reaches."""
        p, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        for depth, (lo, hi) in enumerate(self.levels):
            if depth:
                p, node = np.repeat(p, 2), np.repeat(node * 2, 2)
                node[1::2] += 1
            q = points[p]
            keep = ((q >= lo[node]) & (q <= hi[node])).all(axis=1)
            p, node = p[keep], node[keep]
        slots = self.slots.reshape(-1, self.LEAF)[node]
        keep = slots >= 0
        return np.repeat(p, self.LEAF)[keep.ravel()], slots[keep]


def _within(points: pd.DataFrame, prisms: pd.DataFrame, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(point, prism) index pairs where the point is in the prism, edges included."""
    ax, ay, bx, by, cx, cy = (prisms[c].to_numpy() for c in TRIANGLE)
    zlo, zhi = prisms.zlo.to_numpy(), prisms.zhi.to_numpy()
    tree = BoundingVolumes(
        np.stack([np.minimum(np.minimum(ax, bx), cx), np.minimum(np.minimum(ay, by), cy), zlo], axis=1),
        np.stack([np.maximum(np.maximum(ax, bx), cx), np.maximum(np.maximum(ay, by), cy), zhi], axis=1),
    )
    xyz, found = points[["x", "y", "z"]].to_numpy(), []
    for k in range(0, len(xyz), step):
        p, t = tree.candidates(xyz[k : k + step])
        p += k
        x, y, z = xyz[p].T
        side = lambda ox, oy, dx, dy: (dx[t] - ox[t]) * (y - oy[t]) - (dy[t] - oy[t]) * (x - ox[t])  # noqa: E731, B023
        s1, s2, s3 = side(ax, ay, bx, by), side(bx, by, cx, cy), side(cx, cy, ax, ay)
        flat = ((s1 >= 0) & (s2 >= 0) & (s3 >= 0)) | ((s1 <= 0) & (s2 <= 0) & (s3 <= 0))
        keep = flat & (z >= zlo[t]) & (z <= zhi[t])
        found.append((p[keep], t[keep]))
    return np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found])


def _pairs_of_group(points: pd.DataFrame, prisms: pd.DataFrame, near: bool) -> pd.DataFrame:
    columns = ["region_id", "point_id", "distance"]
    if not len(points) or not len(prisms):
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "distance" else "int64") for c in columns})
    p, t = _within(points, prisms)
    point, region, d = points.point_id.to_numpy()[p], prisms.region_id.to_numpy()[t], np.full(len(p), np.nan)
    if near:
        delta = points[["x", "y", "z"]].to_numpy()[p] - prisms[["ox", "oy", "oz"]].to_numpy()[t]
        half = points.side.to_numpy()[p] / 2
        d = np.sqrt((delta**2).sum(axis=1))
        # forward in z only, and the nearest image only: each pair is met from one side
        ahead = (delta[:, 2] > 0) & (delta[:, 2] < half) | ((delta[:, 2] == 0) | (delta[:, 2] == half)) & (region < point)
        keep = ahead & (np.abs(delta) <= half[:, None]).all(axis=1) & (d <= prisms.reach.to_numpy()[t])
        point, region, d = point[keep], region[keep], d[keep]
    return pd.DataFrame({"region_id": region, "point_id": point, "distance": d}).drop_duplicates(["region_id", "point_id"])


def _tile(v: str, shift: Column | float = 0.0) -> Column:
    return F.floor((F.col(v) + shift) * F.col("tiles") / F.col("side"))


def _tile_pairs(points: DataFrame, prisms: DataFrame, periodic: bool, near: bool, tile_points: int) -> DataFrame:
    """(region_id, point_id, distance) of the points in the prisms of their space.

    points: space, point_id, x, y, z, side, tiles; prisms: space, region_id,
    corners, zlo, zhi, xlo, xhi, ylo, yhi, side, tiles, and for ``near`` ox, oy,
    oz and reach. ``tiles`` is the number of tiles along ``side``.
    """
    last = lambda c: F.least(c, F.col("tiles") - 1) if periodic else c
    axes = ("x", "y", "z")
    placed = points.withColumns({f"t{a}": last(_tile(a)) for a in axes})
    tile = ["space", "tx", "ty", "tz"]
    held = placed.groupBy(*tile).agg(F.count("*").alias("n_points"))
    # the tiles that a prism touches, with the image of the prism that lies there
    spans = {a: F.sequence(F.floor(F.col(f"{a}lo") * F.col("tiles") / F.col("side")), F.floor(F.col(f"{a}hi") * F.col("tiles") / F.col("side"))) for a in ("x", "y")}
    spans["z"] = F.sequence(F.floor(F.col("zlo") * F.col("tiles") / F.col("side")), F.floor(F.col("zhi") * F.col("tiles") / F.col("side"))) if near else F.array(F.lit(0).cast("long"))
    spread = prisms
    for a in axes:
        spread = spread.withColumn(f"i{a}", F.explode(spans[a]))
    if periodic:
        spread = spread.withColumns({f"t{a}": F.pmod(f"i{a}", "tiles") for a in axes} | {f"s{a}": F.floor(F.col(f"i{a}") / F.col("tiles")) * F.col("side") for a in axes})
        moved = {"ax": "sx", "bx": "sx", "cx": "sx", "ay": "sy", "by": "sy", "cy": "sy", "zlo": "sz", "zhi": "sz"} | ({"ox": "sx", "oy": "sy", "oz": "sz"} if near else {})
        spread = spread.withColumns({c: F.col(c) - F.col(s) for c, s in moved.items()})
    else:
        spread = spread.withColumns({f"t{a}": F.col(f"i{a}") for a in axes})
    touched = spread.groupBy(*tile).agg(F.count("*").alias("n_prisms"))
    blocks = held.join(touched, tile).select(*tile, F.ceil(F.col("n_points") / (2 * tile_points)).alias("point_blocks"), F.ceil(F.col("n_prisms") / (16 * tile_points)).alias("prism_blocks"))
    group = [*tile, "point_block", "prism_block"]
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = placed.join(blocks, tile).withColumn("point_block", F.pmod(F.xxhash64("point_id"), F.col("point_blocks"))).withColumn("prism_block", F.explode(upto("prism_blocks")))
    right = spread.join(blocks, tile).withColumn("prism_block", F.pmod(F.xxhash64("region_id"), F.col("prism_blocks"))).withColumn("point_block", F.explode(upto("point_blocks")))
    # both sides may come from one table: own names keep their columns apart
    left = left.select(*[F.col(c).alias(f"l_{c}") for c in group], "point_id", "x", "y", "z", "side")
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in group], "region_id", *TRIANGLE, "zlo", "zhi", *(["ox", "oy", "oz", "reach"] if near else []))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _pairs_of_group(a, b, near)

    return left.groupBy(*[f"l_{c}" for c in group]).cogroup(right.groupBy(*[f"r_{c}" for c in group])).applyInPandas(match, "region_id long, point_id long, distance double")


def regions_of_points(points: DataFrame, polygons: DataFrame, point: str, region: str, tile_side: float | None = None, one_region: bool = False, tile_points: int = 2000, space: str | None = None) -> DataFrame:
    """(point, region): the polygons that contain each point of a plane, edges included.

    points: ``point``, x, y; polygons: ``region``, xs, ys; both with ``space``, if
    one is named, the plane that they are in. A point on the edge between regions
    is in each, or with ``one_region`` in the one with the smallest id. Points
    with null, NaN or infinite coordinates are in none; polygons that
    :func:`polygon_errors` lists hold none. Rows that repeat a point or region
    count once. Without ``tile_side`` a tile holds about ``tile_points``, and is
    no narrower than a quarter of the mean polygon.
    """
    plane = F.lit(0) if space is None else F.col(space)
    placed = points.select(plane.alias("space"), F.col(point).cast("long").alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("z"))
    placed = placed.where(finite(F.col("x")) & finite(F.col("y")) & F.col("point_id").isNotNull()).dropDuplicates(["point_id", "x", "y"])
    shapes = polygons.select(plane.alias("space"), F.col(region).cast("long").alias("region_id"), "xs", "ys").dropDuplicates(["region_id", "xs", "ys"])
    parts = triangulate(shapes, "region_id")
    if space is None:
        parts = parts.withColumn("space", F.lit(0))
    else:
        parts = parts.join(shapes.select("region_id", "space").dropDuplicates(["region_id"]), "region_id")
    edges = {f"{a}{end}": f(*[F.col(f"{c}{a}") for c in "abc"]) for a in "xy" for end, f in (("lo", F.least), ("hi", F.greatest))}
    parts = stage(parts.withColumns(edges | {"zlo": F.lit(0.0), "zhi": F.lit(0.0)}), "triangles")
    if tile_side is None:
        span = lambda a: F.max(a) - F.min(a)
        held = placed.groupBy("space").agg(F.count("*").alias("n"), (span("x") * span("y")).alias("area")).agg(F.sum("n").alias("n"), F.sum("area").alias("area")).first()
        wide = parts.agg(F.avg(F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo"))).alias("w")).first().w
        tile_side = max(((held.area or 0.0) * tile_points / max(1, held.n or 0)) ** 0.5, (wide or 0.0) / 4) or 1.0
    tiles = {"side": F.lit(float(tile_side)), "tiles": F.lit(1)}
    found = _tile_pairs(placed.withColumns(tiles), parts.withColumns(tiles), periodic=False, near=False, tile_points=tile_points).select(F.col("point_id").alias(point), F.col("region_id").alias(region))
    return found.groupBy(point).agg(F.min(region).alias(region)) if one_region else found.distinct()


def near_pairs(points: DataFrame, point: str, space: str, tile_points: int = 2000) -> DataFrame:
    """(region_id, point_id, distance): each pair of points of one periodic space within reach, once.

    points: ``point``, ``space``, x, y, z, side (of the periodic cube), reach (at
    most that distance, the same for all points of a space). Points with a null,
    NaN or infinite coordinate are in no pair, nor those without side or reach.
    Coordinates outside the cube are folded into it. Rows that repeat an id count
    once; points at one place are a pair. Other columns are ignored.
    """
    p = points.select(F.col(point).cast("long").alias("point_id"), F.col(space).alias("space"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "side", "reach")])
    p = p.where(F.col("point_id").isNotNull() & F.col("space").isNotNull() & finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")) & (F.col("side") > 0) & (F.col("reach") >= 0))
    p = p.groupBy("point_id").agg(F.first(F.struct(*[c for c in p.columns if c != "point_id"])).alias("r")).select("point_id", "r.*")
    p = stage(p.withColumns({a: F.pmod(a, "side") for a in ("x", "y", "z")}), "points")
    # about tile_points in a tile, but no tile narrower than the reach
    many = p.groupBy("space").agg(F.count("*").alias("n"), F.max("side").alias("s"), F.max("reach").alias("r"))
    many = many.select("space", F.greatest(F.lit(1), F.least(F.round(F.cbrt(F.col("n") / tile_points)), F.floor(F.try_divide("s", "r")))).cast("int").alias("tiles")).na.fill(1, ["tiles"])
    p = p.join(stage(many, "spaces"), "space")
    # the disc's square is clipped once for each reach and then moved to every point
    reaches = p.groupBy("reach").agg(F.count("*").alias("n"))
    h = F.col("reach") * (1 + 1e-9)
    squares = reaches.select("reach", F.array(-h, h, h, -h).alias("xs"), F.array(-h, -h, h, h).alias("ys"))
    shapes = stage(triangulate(squares, "reach"), "shapes")
    prisms = p.join(shapes, "reach").withColumns({c: F.col(c) + F.col(c[1]) for c in TRIANGLE}).withColumns({"zlo": F.col("z"), "zhi": F.col("z") + h, "ox": F.col("x"), "oy": F.col("y"), "oz": F.col("z")})
    edges = {f"{a}{end}": f(*[F.col(f"{c}{a}") for c in "abc"]) for a in "xy" for end, f in (("lo", F.least), ("hi", F.greatest))}
    prisms = prisms.withColumns(edges).withColumnRenamed("point_id", "region_id").drop("x", "y", "z")
    return _tile_pairs(p, prisms, periodic=True, near=True, tile_points=tile_points)


def near_counts(points: DataFrame, pairs: DataFrame, point: str) -> DataFrame:
    """(point, n_near): the number of partners of each id of ``points`` in ``pairs``, 0 where it has none."""
    ends = pairs.select(F.explode(F.array("region_id", "point_id")).alias(point)).groupBy(point).agg(F.count("*").alias("n"))
    ids = points.select(F.col(point).cast("long").alias(point)).where(F.col(point).isNotNull()).distinct()
    return ids.join(ends, point, "left").select(point, F.coalesce("n", F.lit(0)).cast("long").alias("n_near"))
