"""Tidal descriptors of halos: scale brackets, eigenvalues, anisotropy, joins by grid cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cosmology import linear_in_scale
from skylattice.operators.stats import first_per_key

COMPONENTS = ("t00", "t01", "t02", "t11", "t12", "t22")


def scale_brackets(df: DataFrame, scales: list[float], radius: str = "rg") -> DataFrame:
    """Add s0 and s1, the tabulated scales around the radius: s0 <= radius < s1.

    Rows outside the table, or without radius, fall away; the scales are a short list.
    """
    steps = sorted(scales)
    spans = F.array(*[F.struct(F.lit(a).alias("s0"), F.lit(b).alias("s1")) for a, b in zip(steps, steps[1:], strict=False)])
    span = F.get(F.filter(spans, lambda s: (s["s0"] <= F.col(radius)) & (F.col(radius) < s["s1"])), F.lit(0))
    return df.withColumn("_s", span).where("_s IS NOT NULL").select("*", "_s.s0", "_s.s1").drop("_s")


def eigenvalues(t00: Column, t01: Column, t02: Column, t11: Column, t12: Column, t22: Column) -> Column:
    """Array of the ascending eigenvalues of a symmetric 3x3 matrix, in closed form."""
    q = (t00 + t11 + t22) / 3
    off = t01 * t01 + t02 * t02 + t12 * t12
    p = F.sqrt(((t00 - q) ** 2 + (t11 - q) ** 2 + (t22 - q) ** 2 + 2 * off) / 6)
    a, b, c = t00 - q, t11 - q, t22 - q
    half = F.try_divide(a * (b * c - t12 * t12) - t01 * (t01 * c - t12 * t02) + t02 * (t01 * t12 - b * t02), 2 * p * p * p)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    # p is 0 for a multiple of the unit matrix
    return F.when(half.isNull(), F.array(q, q, q)).otherwise(F.array(low, 3 * q - high - low, high))


def anisotropy(l1: Column, l2: Column, l3: Column) -> tuple[Column, Column]:
    """(tidal anisotropy, overdensity) of three eigenvalues."""
    delta = l1 + l2 + l3
    q2 = ((l1 - l2) ** 2 + (l2 - l3) ** 2 + (l3 - l1) ** 2) / 2
    return F.try_divide(F.sqrt(q2), 1 + delta + 1e-15), delta


def at_cells(halos: DataFrame, tensors: DataFrame, scale: str, prefix: str) -> DataFrame:
    """``halos`` with the eigenvalues (array ``prefix``) of the tensor in their cell at the scale in a column."""
    t = tensors.select("space", F.col("scale").alias(scale), "i", "j", "k", eigenvalues(*[F.col(c) for c in COMPONENTS]).alias(prefix))
    return halos.join(t, ["space", scale, "i", "j", "k"])


def _inside(halos: DataFrame, scales: list[float]) -> DataFrame:
    lowest, highest = min(scales), max(scales)
    return scale_brackets(halos.where((F.col("rg") > lowest) & (F.col("rg") < highest)), scales)


def cells_read(halos: DataFrame, scales: list[float]) -> DataFrame:
    """(space, scale, i, j, k): the cells and scales whose tensors :func:`descriptors` reads."""
    return _inside(halos, scales).select("space", F.explode(F.array("s0", "s1")).alias("scale"), "i", "j", "k").distinct()


def descriptors(halos: DataFrame, tensors: DataFrame, scales: list[float]) -> DataFrame:
    """``halos`` with tidal_anisotropy and overdensity at their own radius.

    halos: space, i, j, k, rg; tensors: space, scale, i, j, k and six components.
    The eigenvalues at the two tabulated scales around rg are interpolated. Halos
    whose radius is not strictly inside the table have no row.
    """
    rows = _inside(halos, scales)
    rows = at_cells(at_cells(rows, tensors, "s0", "_l0"), tensors, "s1", "_l1")
    lam = [linear_in_scale(F.get("_l0", F.lit(k)), F.get("_l1", F.lit(k)), F.col("s0"), F.col("s1"), F.col("rg")) for k in range(3)]
    alpha, delta = anisotropy(*lam)
    return rows.withColumns({"tidal_anisotropy": alpha, "overdensity": delta}).drop("_l0", "_l1", "s0", "s1")


def attach_by_cell(halos: DataFrame, described: DataFrame, key: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """``halos`` with the descriptor values of their grid cell, null where the cell has none.

    Of the descriptors of a cell the first in the given order counts, also for
    halos other than its own.
    """
    firsts = first_per_key(described.select(*key, *values, *[o.alias(f"_k{n}") for n, o in enumerate(order)]), key, [F.col(f"_k{n}") for n in range(len(order))])
    return halos.join(firsts.select(*key, *values), key, "left")
