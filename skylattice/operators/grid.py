"""Deposits on and samples from periodic grids, one grid for each space.

A grid is a long table (space, i, j, k, v) without rows for empty cells; means
are taken over all n^3 cells, empty ones included. Points with a null, NaN or
infinite coordinate are left out, positions outside the box are folded into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.runtime import finite

CELL = ("i", "j", "k")
#: Cells that a task of :func:`full_overdensity` holds at a time.
BLOCK = 1 << 20


def placed(points: DataFrame, space: str = "box", side: str = "side") -> DataFrame:
    """The points with finite coordinates in a known box."""
    ok = F.col(space).isNotNull() & (F.col(side) > 0)
    for a in "xyz":
        ok = ok & finite(F.col(a))
    return points.where(ok)


def cell_index(position: Column, side: Column, n: int) -> Column:
    """Index of the cell that holds a position, 0 to n-1, periodic."""
    return F.pmod(F.floor(position / (side / n)), F.lit(n)).cast("int")


def nearest_cells(points: DataFrame, n: int, side: str = "side") -> DataFrame:
    """Add i, j, k of the cell of each point."""
    return points.withColumns({c: cell_index(F.col(a), F.col(side), n) for c, a in zip(CELL, "xyz", strict=True)})


def _corners(n: int, side: str) -> Column:
    """The eight cells that share a point, with the share of each."""
    g = {a: F.col(a) / (F.col(side) / n) for a in "xyz"}
    low = {a: F.floor(g[a]) for a in "xyz"}
    part = {a: g[a] - low[a] for a in "xyz"}
    corners = []
    for d in ((p, q, r) for p in (0, 1) for q in (0, 1) for r in (0, 1)):
        w = F.lit(1.0)
        for a, up in zip("xyz", d, strict=True):
            w = w * (part[a] if up else 1 - part[a])
        corners.append(F.struct(*[F.pmod(low[a] + up, F.lit(n)).cast("int").alias(c) for c, a, up in zip(CELL, "xyz", d, strict=True)], w.alias("w")))
    return F.array(*corners)


def corner_shares(points: DataFrame, n: int, side: str = "side") -> DataFrame:
    """Each point eight times, with the cell (i, j, k) and its share w; the shares of a point add to 1."""
    return points.withColumn("corner", F.explode(_corners(n, side))).select(*points.columns, "corner.*")


def cloud_in_cell(points: DataFrame, n: int, weight: str | None = None, space: str = "box", side: str = "side") -> DataFrame:
    """(space, i, j, k, v): the weights of all points, or their number, spread over the eight nearest cells.

    Null and NaN weights add nothing.
    """
    w = F.lit(1.0) if weight is None else F.when(finite(F.col(weight)), F.col(weight))
    rows = placed(points, space, side).select(F.col(space).alias("space"), "x", "y", "z", F.col(side).alias("side"), w.alias("weight"))
    return corner_shares(rows, n).groupBy("space", *CELL).agg(F.sum(F.col("w") * F.col("weight")).alias("v")).where("v IS NOT NULL")


def density(deposit: DataFrame, sides: DataFrame, n: int) -> DataFrame:
    """Deposited mass over the volume of a cell; sides: space, side."""
    return deposit.join(sides, "space").select("space", *CELL, (F.col("v") / F.pow(F.col("side") / n, F.lit(3))).alias("v"))


def overdensity(grid: DataFrame, n: int) -> DataFrame:
    """v over the mean of all n^3 cells of its space, less 1, in the cells that hold anything.

    Absent cells are at -1. A space whose mean is not positive has no rows.
    """
    means = grid.groupBy("space").agg((F.sum("v") / n**3).alias("mean")).where("mean > 0")
    return grid.join(means, "space").select("space", *CELL, (F.col("v") / F.col("mean") - 1).alias("v"))


def overdensity_expected(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """v over an expected density (space, expected), less 1."""
    return grid.join(expected, "space").select("space", *CELL, (F.try_divide("v", "expected") - 1).alias("v"))


def in_runs(rows: DataFrame, n: int, keys: list[str], order: list[str], tasks: int) -> DataFrame:
    """Rows of one key in one task and in one run. Where whole grids of many cells come of few rows there are ``tasks`` tasks, which AQE, seeing few bytes, would join."""
    many = [max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if n >= 32 else []
    return rows.repartition(*many, *keys).sortWithinPartitions(*order)


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    ends = [0, *np.flatnonzero(new).tolist(), len(new)]
    return list(zip(ends, ends[1:], strict=False))


def full_grid(grid: DataFrame, n: int, empty: float) -> DataFrame:
    """All n^3 cells of each space, absent ones at ``empty``.

    Only the cells given and a row for each plane are shuffled; a task makes the
    other cells, a plane at a time.
    """
    inside = F.lit(True)
    for c in CELL:
        inside = inside & F.col(c).between(0, n - 1)
    cells = grid.where(inside & F.col("v").isNotNull()).select("space", F.col("i").cast("int").alias("i"), (F.col("j") * n + F.col("k")).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
    planes = grid.select("space").distinct().select("space", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("v"))
    rows = in_runs(cells.unionByName(planes), n, ["space", "i"], ["space", "i"], n**3 >> 16)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane, values = None, np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            space, i = batch["space"].to_numpy(zero_copy_only=False), batch["i"].to_numpy()
            at, v = batch["at"].to_numpy(zero_copy_only=False), batch["v"].to_numpy(zero_copy_only=False)
            for lo, hi in runs_of(space, i):
                now = (batch["space"][lo], int(i[lo]))
                if now != plane:
                    if plane is not None:
                        yield pencils(*plane, values)
                    plane, values = now, np.full(n * n, float(empty))
                some = at[lo:hi] == at[lo:hi]
                values[at[lo:hi][some].astype(np.int64)] = v[lo:hi][some]
        if plane is not None:
            yield pencils(*plane, values)

    return cells_of(rows.mapInArrow(fill, pencil_schema(grid)))


def in_cells(points: DataFrame, n: int) -> DataFrame:
    """(space, x, y, z): the points that can be placed, in units of a cell."""
    return placed(points).select(F.col("box").alias("space"), *[(F.col(a) / (F.col("side") / n)).alias(a) for a in "xyz"])


def deposit(cells: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, z: np.ndarray, first: int = 0) -> None:
    """Add points of :func:`in_cells` to the eight nearest cells, of which ``cells`` has those from the plane ``first`` on."""
    low = [np.floor(c) for c in (x, y, z)]
    part = [c - at for c, at in zip((x, y, z), low, strict=True)]
    low = [np.mod(at, n).astype(np.int64) for at in low]
    for d in np.ndindex(2, 2, 2):
        i, j, k = ((at + up) % n for at, up in zip(low, d, strict=True))
        w = np.ones(len(x))
        for share, up in zip(part, d, strict=True):
            w = w * (share if up else 1 - share)
        at = ((i - first) * n + j) * n + k
        mine = (at >= 0) & (at < len(cells))
        np.add.at(cells, at[mine], w[mine])


def full_overdensity(points: DataFrame, n: int, digits: int) -> DataFrame:
    """(space, i, j, k, v): :func:`full_grid` of the overdensity of points, rounded to ``digits``.

    The points are shuffled, and not the eight cells of each; a task deposits
    them on a block of planes.
    """
    rows, planes = in_cells(points, n), max(1, BLOCK // n**2)
    means = rows.groupBy("space").agg((F.count("*") / n**3).alias("mean"))
    at = F.pmod(F.floor("x"), F.lit(n))
    blocks = F.array_distinct(F.transform(F.array(at, F.pmod(at + 1, F.lit(n))), lambda i: F.floor(i / planes).cast("int")))
    rows = rows.select("space", F.explode(blocks).alias("block"), F.lit(None).cast("double").alias("mean"), *"xyz")
    every = means.select("space", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // planes))).alias("block"), "mean", *[F.lit(None).cast("double").alias(a) for a in "xyz"])
    rows = in_runs(rows.unionByName(every), n, ["space", "block"], ["space", "block"], n)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mean, cells = None, 0.0, np.empty(0)

        def made() -> Iterator[pa.RecordBatch]:
            space, b = block
            for i, plane in enumerate(cells.reshape(-1, n * n), b * planes):
                values, some = np.full(n * n, -1.0), np.flatnonzero(plane)
                v = plane[some] / mean - 1
                scaled = v * 10**digits
                values[some] = np.where(np.abs(scaled) < 2**52, np.trunc(scaled + np.copysign(0.5, scaled)) / 10**digits, v) + 0.0
                yield pencils(space, i, values)

        for batch in batches:
            if not batch.num_rows:
                continue
            of, means_, has = batch["block"].to_numpy(), batch["mean"].to_numpy(zero_copy_only=False), batch["x"].is_valid().to_numpy(zero_copy_only=False)
            places = [batch[a].to_numpy(zero_copy_only=False) for a in "xyz"]
            for lo, hi in runs_of(batch["space"].to_numpy(zero_copy_only=False), of):
                now = (batch["space"][lo], int(of[lo]))
                if now != block:
                    if block is not None:
                        yield from made()
                    block, cells = now, np.zeros((min(n, (now[1] + 1) * planes) - now[1] * planes) * n * n)
                given = has[lo:hi]
                mean = float(means_[lo:hi][~given][0]) if not given.all() else mean
                deposit(cells, n, *[c[lo:hi][given] for c in places], first=block[1] * planes)
        if block is not None:
            yield from made()

    return cells_of(rows.mapInArrow(fill, pencil_schema(rows)))


def pencil_schema(grid: DataFrame) -> T.StructType:
    """(space, i, j, v): the cells (i, j, 0 to n-1) of a grid as an array, which costs less between Python and Spark than n rows."""
    whole = T.IntegerType()
    return T.StructType([T.StructField("space", grid.schema["space"].dataType), T.StructField("i", whole, False), T.StructField("j", whole, False), T.StructField("v", T.ArrayType(T.DoubleType(), False), False)])


def pencils(space: pa.Scalar, i: int, plane: np.ndarray) -> pa.RecordBatch:
    """The pencils of the plane i."""
    n = int(np.sqrt(plane.size) + 0.5)
    v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n + 1, n, dtype=np.int32)), pa.array(plane.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.repeat(space, n), pa.repeat(pa.scalar(i, pa.int32()), n), pa.array(np.arange(n, dtype=np.int32)), v], names=["space", "i", "j", "v"])


def cells_of(pencil_rows: DataFrame) -> DataFrame:
    """(space, i, j, k, v) of pencils."""
    return pencil_rows.select("space", "i", "j", F.posexplode("v").alias("k", "v"))


def trilinear(points: DataFrame, grid: DataFrame, n: int, id_: str = "id", empty: float = 0.0, space: str = "box", side: str = "side") -> DataFrame:
    """(id, v): the grid at each point, linear between the eight nearest cells; absent cells are at ``empty``."""
    rows = placed(points, space, side).select(id_, F.col(space).alias("space"), "x", "y", "z", F.col(side).alias("side"))
    met = corner_shares(rows, n).join(grid, ["space", *CELL], "left")
    return met.groupBy(id_).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(float(empty)))).alias("v"))
