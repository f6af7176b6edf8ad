"""Ranks and what is built on them, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.runtime import stage


def row_numbers(df: DataFrame, groups: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in the given order.

    All groups are sorted as one, by range partitions. Each partition numbers its
    own rows; the sizes of the partitions, one small row each, give its offset.
    A null group key is a group of its own. Ties need a last order column.
    """
    ordered = [F.asc_nulls_first(g) for g in groups] + order
    parts = stage(df.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id()), "ranges")
    key = ["_part", *groups]
    sizes = parts.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = parts.withColumn("_row", within).alias("a")
    same = F.col("a._part") == F.col("b._part")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = numbered.join(offsets.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_row") + F.col("_before")).cast("long").alias(into))


def average_ranks(df: DataFrame, groups: list[str], value: str, into: str = "rank") -> DataFrame:
    """Ascending ranks of the values in their group; equal values share the mean of their ranks.

    Ranks come from the counts of the distinct values, so repeated values cost
    nothing. Null and NaN values have a null rank.
    """
    known = F.when(~F.isnan(value), F.col(value))
    counted = df.withColumn("_v", known).where("_v IS NOT NULL").groupBy(*groups, "_v").agg(F.count("*").alias("_c"))
    numbered = running(counted, groups, "_v", "_c", "_upto")
    ranks = numbered.select(*groups, "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(into))
    same = F.col("a._v") == F.col("b._v")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return df.withColumn("_v", known).alias("a").join(ranks.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in df.columns], F.col(f"b.{into}").alias(into))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, n, <name>): the values at the named shares (0 to 1) of each group, linear between values.

    The rows beside each share are found by rank, so no group's values are
    gathered. Null and NaN values do not count; a group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("_v"))
    numbered = row_numbers(rows, groups, [F.asc("_v")], "_k")
    sizes = numbered.groupBy(*groups).agg(F.max("_k").alias("n"))
    # the position of each share is found in the one row of a group, and its two neighbours by a combined maximum
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    met = numbered.alias("a").join(sizes.alias("b"), same) if groups else numbered.alias("a").join(sizes.alias("b"))
    met = met.select(*[F.col(f"a.{g}").alias(g) for g in groups], "_v", "_k", "n")
    at = {name: F.round(F.lit(float(share)) * (F.col("n") - 1) + 1, 9) for name, share in shares.items()}
    beside = [F.max(F.when(F.col("_k") == F.floor(x) + k, F.col("_v"))).alias(f"{name}_{k}") for name, x in at.items() for k in (0, 1)]
    found = met.groupBy(*groups).agg(F.max("n").alias("n"), *beside)
    mixed = [(F.col(f"{name}_0") + F.coalesce((x - F.floor(x)) * (F.col(f"{name}_1") - F.col(f"{name}_0")), F.lit(0.0))).alias(name) for name, x in at.items()]
    return found.select(*groups, "n", *mixed)


def running(df: DataFrame, groups: list[str], order: str, amount: str, into: str) -> DataFrame:
    """Running sums along ``order`` in each group, by range partitions with offsets."""
    ordered = [F.asc_nulls_first(g) for g in groups] + [F.col(order)]
    parts = stage(df.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id()), "ranges")
    key = ["_part", *groups]
    sums = parts.groupBy(*key).agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = F.sum(amount).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("a._part") == F.col("b._part")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = parts.withColumn("_w", within).alias("a").join(offsets.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_w") + F.col("_before")).alias(into))


def cumulative_counts(df: DataFrame, groups: list[str], mass: str, id_: str, volume: Column) -> DataFrame:
    """Add rank by falling mass and ``n_above``, the rank over the volume: the cumulative mass function."""
    ok = df.where((F.col(mass) > 0) & ~F.isnan(mass))
    return row_numbers(ok, groups, [F.desc(mass), F.asc(id_)]).withColumn("n_above", F.col("rank") / volume)


def abundance_match(target: DataFrame, reference: DataFrame, groups: list[str], mass: str, id_: str, volume_ratio: float = 1.0) -> DataFrame:
    """(groups, id, mass, matched_mass): the reference mass at the same number density, per group.

    Both sides are ranked by falling mass, ties by id. ``volume_ratio`` is the
    reference volume over that of the target. Between two reference ranks the
    logarithm of mass is linear in the logarithm of rank, beyond the ends the end
    value holds. Masses that are null, NaN or not positive are left out; targets
    of a group without reference get a null.
    """
    good = lambda df: df.where((F.col(mass) > 0) & ~F.isnan(mass)).select(*groups, id_, mass)
    falling = [F.desc(mass), F.asc(id_)]
    ref = row_numbers(good(reference), groups, falling).select(*groups, F.col("rank").alias("at"), F.log10(mass).alias("lm"))
    size = ref.groupBy(*groups).agg(F.max("at").alias("n_ref"))
    tgt = row_numbers(good(target), groups, falling).join(size, groups, "left")
    x = F.greatest(F.lit(1.0), F.least(F.col("rank") * F.lit(float(volume_ratio)), F.col("n_ref").cast("double")))
    tgt = tgt.withColumn("x", F.when(F.col("n_ref").isNotNull(), x)).withColumn("at", F.floor("x"))
    lower, upper = ref.withColumnRenamed("lm", "lm0"), ref.select(*groups, (F.col("at") - 1).alias("at"), F.col("lm").alias("lm1"))
    met = tgt.join(lower, [*groups, "at"], "left").join(upper, [*groups, "at"], "left")
    t = (F.log10("x") - F.log10("at")) / (F.log10(F.col("at") + 1) - F.log10("at"))
    return met.select(*groups, id_, mass, F.pow(F.lit(10.0), F.col("lm0") + F.coalesce(t * (F.col("lm1") - F.col("lm0")), F.lit(0.0))).alias("matched_mass"))


def abundance_match_cdf(target: DataFrame, reference: DataFrame, groups: list[str], mass: str, id_: str) -> DataFrame:
    """(groups, id, mass, matched_mass): the reference mass at the same quantile, ties sharing the mean rank."""
    good = lambda df: df.where((F.col(mass) > 0) & ~F.isnan(mass)).select(*groups, id_, mass)
    ref = row_numbers(good(reference), groups, [F.asc(mass), F.asc(id_)]).select(*groups, F.col("rank").alias("at"), F.col(mass).alias("m"))
    n_ref = ref.groupBy(*groups).agg(F.max("at").alias("n_ref"))
    tgt = average_ranks(good(target), groups, mass)
    n_tgt = tgt.groupBy(*groups).agg(F.count("*").alias("n_tgt"))
    tgt = tgt.join(n_tgt, groups).join(n_ref, groups, "left")
    x = F.col("rank") / (F.col("n_tgt") + 1) * (F.col("n_ref") + 1)
    tgt = tgt.withColumn("x", F.greatest(F.lit(1.0), F.least(x, F.col("n_ref").cast("double")))).withColumn("x", F.when(F.col("n_ref").isNotNull(), F.col("x"))).withColumn("at", F.floor("x"))
    lower, upper = ref.withColumnRenamed("m", "m0"), ref.select(*groups, (F.col("at") - 1).alias("at"), F.col("m").alias("m1"))
    met = tgt.join(lower, [*groups, "at"], "left").join(upper, [*groups, "at"], "left")
    return met.select(*groups, id_, mass, (F.col("m0") + F.coalesce((F.col("x") - F.col("at")) * (F.col("m1") - F.col("m0")), F.lit(0.0))).alias("matched_mass"))


def spearman(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, rho): rank correlation over the rows in which both values are known."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(*groups, a, b)
    ranked = average_ranks(average_ranks(both, groups, a, "_ra"), groups, b, "_rb")
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
