"""Nearest neighbours and one-to-one matching in periodic boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.operators.grid import placed
from skylattice.runtime import stage


def _slot(a: str) -> Column:
    return F.least(F.floor(F.col(a) / F.col("side") * F.col("cells")), F.col("cells") - 1)


def radius_pairs(queries: DataFrame, points: DataFrame, reach: Column, inclusive: bool = True) -> DataFrame:
    """(a, b, distance): points b of the box of a within ``reach`` of it, periodic.

    Both tables have id, box, side, x, y, z inside the box. Cells are at least as
    wide as the reach, an expression over box columns of both tables, so that the
    27 around a point hold all partners. Rows without a finite position have none.
    """
    cells = F.greatest(F.lit(1), F.floor(F.col("side") / reach)).cast("long")
    held = placed(points).withColumn("cells", cells)
    held = held.select(F.col("box"), *[_slot(a).alias(f"c{a}") for a in "xyz"], F.col("id").alias("b"), *[F.col(a).alias(f"b{a}") for a in "xyz"])
    ask = placed(queries).withColumns({"cells": cells, "reach": reach})
    for a in "xyz":
        ask = ask.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(*[F.pmod(_slot(a) + k, F.col("cells")) for k in (-1, 0, 1)]))))
    ask = ask.select("box", "cx", "cy", "cz", F.col("id").alias("a"), *[F.col(a).alias(f"a{a}") for a in "xyz"], "side", "reach")
    apart = lambda a: F.col(f"a{a}") - F.col(f"b{a}") - F.col("side") * F.rint((F.col(f"a{a}") - F.col(f"b{a}")) / F.col("side"))
    pairs = ask.join(held, ["box", "cx", "cy", "cz"]).withColumn("distance", F.sqrt(apart("x") ** 2 + apart("y") ** 2 + apart("z") ** 2))
    return pairs.where(F.col("distance") <= F.col("reach") if inclusive else F.col("distance") < F.col("reach")).select("a", "b", "distance")


def nearest(queries: DataFrame, points: DataFrame, k: int, reach: Column) -> DataFrame:
    """(a, b, distance, rank): up to k nearest points closer than ``reach``; ties by id."""
    by = Window.partitionBy("a").orderBy("distance", "b")
    return radius_pairs(queries, points, reach, inclusive=False).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def match_one_to_one(high: DataFrame, low: DataFrame, k: int = 10, reach: Column | None = None, max_gap: Column | None = None, passes: int | None = None) -> DataFrame:
    """(hr_id, lr_id, distance): halos of ``high`` matched with their closest free partner in ``low``.

    Each halo of ``high`` names its k nearest partners; those whose mass differs
    by ``max_gap`` of its own or more are dropped. A partner goes to whoever is
    nearest, and who lost it takes the next: the stable matching, found by taking
    all pairs that are the nearest of both ends, again and again among the rest.
    Both tables have id, box, side, m200b and a position; ``reach`` and
    ``max_gap`` are expressions of ``high``. Unknown masses match nobody. Ties go
    to the smaller ids. ``passes`` stops early.
    """
    reach = F.col("r_match") if reach is None else reach
    gap = F.col("max_mass_distance") if max_gap is None else max_gap
    near = nearest(high, low, k, reach)
    h = high.select(F.col("id").alias("a"), F.col("m200b").alias("ma"), gap.alias("gap"))
    edges = near.join(h, "a").join(low.select(F.col("id").alias("b"), F.col("m200b").alias("mb")), "b")
    edges = edges.where((F.abs(F.col("mb") - F.col("ma")) / F.col("ma") < F.col("gap")) & (F.col("ma") > 0) & (F.col("mb") > 0)).select("a", "b", "distance")
    edges, found, n = stage(edges, "edges"), [], 0
    while passes is None or n < passes:
        n += 1
        first = lambda end: F.row_number().over(Window.partitionBy(end).orderBy("distance", "a", "b"))
        best = stage(edges.withColumns({"_a": first("a"), "_b": first("b")}).where("_a = 1 AND _b = 1").drop("_a", "_b"), "matched")
        found.append(best)
        edges = stage(edges.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"), "edges")
        if edges.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("a").alias("hr_id"), F.col("b").alias("lr_id"), "distance")


def transferred_mass(low: DataFrame, high: DataFrame, matches: DataFrame) -> DataFrame:
    """``low`` with m200b_cal and hr_id of its partner, null where it has none, and ``matched``."""
    partner = matches.select(F.col("lr_id").alias("id"), "hr_id").join(high.select(F.col("id").alias("hr_id"), F.col("m200b").alias("m200b_cal")), "hr_id")
    return low.join(partner, "id", "left").withColumn("matched", F.col("hr_id").isNotNull())
