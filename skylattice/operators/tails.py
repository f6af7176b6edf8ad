"""Joint tails of several properties and the bias of the halos in them."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.ranks import row_numbers, running
from skylattice.operators.stats import standard_error
from skylattice.runtime import finite


def _known(df: DataFrame, properties: list[str]) -> DataFrame:
    return df.where(reduce(operator.and_, [finite(F.col(p)) for p in properties]))


def _long(df: DataFrame, keep: list[str], properties: list[str]) -> DataFrame:
    """(keep, _q, _v): one row for each property and value."""
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("_q"), F.col(q).cast("double").alias("_v")) for q in properties])).alias("_each")
    return df.select(*keep, each).select(*keep, "_each.*")


def joint_percentile(df: DataFrame, groups: list[str], properties: list[str], id_: str, share: float = 0.25) -> DataFrame:
    """(groups, n, p): the lowest percentile below which, in every property at once, the share of rows lies.

    Closed form: a row's depth is its highest rank over the properties, and p the
    percentile of the depth that the share of rows does not exceed. Rows with an
    unknown property are left out; equal values share their highest rank; a group
    of one row has the lowest percentile.
    """
    rows = _long(_known(df, properties), [*groups, id_], properties)
    # one sort for all properties: the highest rank of a value is the number of values up to it
    counted = rows.groupBy(*groups, "_q", "_v").agg(F.count("*").alias("_c"))
    upto = running(counted, [*groups, "_q"], "_v", "_c", "_upto").select(*groups, "_q", "_v", "_upto")
    deep = rows.join(upto, [*groups, "_q", "_v"]).groupBy(*groups, id_).agg((F.max("_upto") - 1).alias("_m"))
    ranked = row_numbers(deep.select(*groups, id_, "_m"), groups, [F.asc("_m"), F.asc(id_)], "_k")
    sizes = ranked.groupBy(*groups).agg(F.count("*").alias("n"))
    at = ranked.join(sizes, groups).where(F.col("_k") == F.ceil(F.col("n") * share))
    p = F.coalesce(100 * F.try_divide(F.col("_m"), F.col("n") - 1), F.lit(0.0))
    return at.select(*groups, "n", F.least(F.greatest(p, F.lit(1e-6)), F.lit(99.99)).alias("p"))


def tail_limits(df: DataFrame, groups: list[str], properties: list[str], solved: DataFrame) -> DataFrame:
    """(groups, low_<p>, high_<p>): the values at percentile p and 100 - p of each property, linear between values.

    The rows beside each limit are found by rank, so no group's values are gathered.
    """
    values = _long(_known(df, properties), groups, properties)
    numbered = row_numbers(values, [*groups, "_q"], [F.asc("_v")], "_k")
    met = numbered.join(solved.select(*groups, "p", "n"), groups)
    at = {name: F.round(pct / 100 * (F.col("n") - 1) + 1, 9) for name, pct in (("low", F.col("p")), ("high", 100 - F.col("p")))}
    picked = [F.max(F.when((F.col("_q") == q) & (F.col("_k") == F.floor(x) + k), F.col("_v"))).alias(f"{name}_{q}_{k}") for q in properties for name, x in at.items() for k in (0, 1)]
    found = met.groupBy(*groups, "p", "n").agg(*picked)
    mixed = lambda q, name, x: F.col(f"{name}_{q}_0") + F.coalesce((x - F.floor(x)) * (F.col(f"{name}_{q}_1") - F.col(f"{name}_{q}_0")), F.lit(0.0))
    return found.select(*groups, "p", "n", *[mixed(q, name, x).alias(f"{name}_{q}") for q in properties for name, x in at.items()])


def in_tails(df: DataFrame, limits: DataFrame, groups: list[str], properties: list[str]) -> DataFrame:
    """Add ``lower`` and ``upper``: up to every low limit, from every high one on; unknown values are in neither.

    A limit is the end of the search for the lowest percentile that gives the
    share, so the row that sets it is inside. The limits may come from another table, as for thresholds of a reference catalogue.
    """
    met = df.join(limits.drop("p", "n"), groups, "left")
    every = lambda parts: F.coalesce(reduce(operator.and_, parts), F.lit(False))
    sure = [finite(F.col(p)) for p in properties]
    return met.withColumns({
        "lower": every(sure + [F.col(p) <= F.col(f"low_{p}") for p in properties]),
        "upper": every(sure + [F.col(p) >= F.col(f"high_{p}") for p in properties]),
    }).drop(*[f"{n}_{p}" for p in properties for n in ("low", "high")])


def bias_curves(marked: DataFrame, groups: list[str], bias: str, center: Column) -> DataFrame:
    """(groups, center, tail, n, mean_bias, sem): the bias of both tails; empty tails have no row.

    ``center`` is the middle of a group's mass bin, an expression of the group columns.
    """
    b = F.when(finite(F.col(bias)), F.col(bias))
    sides = F.explode(F.array_compact(F.array(F.when(F.col("lower"), F.lit("lower")), F.when(F.col("upper"), F.lit("upper"))))).alias("tail")
    rows = marked.select(*groups, b.alias("_b"), sides)
    return rows.groupBy(*groups, "tail").agg(F.count("_b").alias("n"), F.avg("_b").alias("mean_bias"), standard_error(F.col("_b")).alias("sem")).withColumn("center", center)

