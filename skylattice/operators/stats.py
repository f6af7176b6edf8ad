"""Binned statistics, mass functions and histograms. Null and NaN values count nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.functions.cosmology import bin_of
from skylattice.operators.ranks import quantiles
from skylattice.runtime import finite


def known(column: str) -> Column:
    return F.when(finite(F.col(column)), F.col(column))


def bins_table(df: DataFrame, edges: list[float]) -> DataFrame:
    """(bin, lo, hi): one row for each bin."""
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return df.sparkSession.createDataFrame(rows, "bin int, lo double, hi double")


def mass_function(df: DataFrame, edges: list[float], groups: list[str], mass: str = "m200b", volume: Column | None = None) -> DataFrame:
    """(groups, bin, lo, hi, center, n, density): halos for each mass bin, empty bins too; the last bin is closed.

    density is n over the volume (a column of ``df`` that is the same in a group).
    """
    v = F.lit(1.0) if volume is None else volume
    counted = df.withColumn("bin", bin_of(F.col(mass), edges, closed=True)).groupBy(*groups, "bin").agg(F.count("*").alias("n"))
    volumes = df.groupBy(*groups).agg(F.max(v).alias("volume"))
    every = volumes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2)))).join(F.broadcast(bins_table(df, edges)), "bin")
    joined = every.join(counted.where("bin IS NOT NULL"), [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.select(*groups, "bin", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("center"), "n", (F.col("n") / F.col("volume")).alias("density"))


def log_mass_function(hmf: DataFrame) -> DataFrame:
    """The filled bins of :func:`mass_function` with log10 of the density."""
    return hmf.where("n > 0").withColumn("log_density", F.log10("density"))


def pivoted(hmf: DataFrame, catalog: str, names: list[str], value: str = "density") -> DataFrame:
    """One row for each bin and one column for each catalogue."""
    return hmf.groupBy("bin").pivot(catalog, names).agg(F.max(value))


def mean_of_realisations(hmf: DataFrame, realisation: str, keep: list[str]) -> DataFrame:
    """(keep, bin, mean_density, mean_n, n_realisations): averages over realisations; density over filled bins only."""
    return hmf.groupBy(*keep, "bin").agg(F.avg(F.when(F.col("n") > 0, F.col("density"))).alias("mean_density"), F.avg("n").alias("mean_n"), F.countDistinct(realisation).alias("n_realisations"))


#: the shares between which the central 68.3 percent lie
CENTRAL = (0.1585, 0.8415)


def beside(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``one`` with those of ``other`` that have the same keys, null keys too."""
    if not keys:
        return one.join(other)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return one.alias("a").join(other.alias("b"), same, "left").select("a.*", *[f"b.{c}" for c in other.columns if c not in keys])


def standard_error(column: Column) -> Column:
    """Standard error of the mean: 0 for one value, null for none."""
    return F.when(F.count(column) == 1, F.lit(0.0)).when(F.count(column) > 1, F.stddev_samp(column) / F.sqrt(F.count(column)))


def binned(df: DataFrame, by: Column, edges: list[float], value: str, groups: list[str], closed: bool = False) -> DataFrame:
    """(groups, bin, n, median, mean, std, half_width, sem) of the values in each filled bin; std has no correction."""
    v, keys = F.col("_v"), [*groups, "bin"]
    rows = df.select(*groups, bin_of(by, edges, closed).alias("bin"), known(value).alias("_v")).where("bin IS NOT NULL AND _v IS NOT NULL")
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), standard_error(v).alias("sem"))
    middle = quantiles(rows, keys, "_v", {"median": 0.5, "_low": CENTRAL[0], "_high": CENTRAL[1]}).drop("n")
    return beside(plain, middle, keys).select(*keys, "n", "median", "mean", "std", ((F.col("_high") - F.col("_low")) / 2).alias("half_width"), "sem")


def log_median_by_mass(df: DataFrame, edges: list[float], value: str, groups: list[str], mass: str = "m200b") -> DataFrame:
    """(groups, bin, median, mean): 10 to the median and mean of log10 of the value, in bins of log10 mass.

    The edges are in log10 of mass; raises if they look like masses.
    """
    if max(edges) > 30:
        raise ValueError("the edges are logarithms of mass")
    logs = df.withColumn("_l", F.log10(F.when(F.col(value) > 0, F.col(value))))
    found = binned(logs, F.log10(F.when(F.col(mass) > 0, F.col(mass))), edges, "_l", groups, closed=True)
    return found.select(*groups, "bin", F.pow(F.lit(10.0), "median").alias("median"), F.pow(F.lit(10.0), "mean").alias("mean"))


def histogram2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float], groups: list[str]) -> DataFrame:
    """(groups, bx, by, n, share): counts in the filled cells, last edges closed, and their share of all counted."""
    rows = df.withColumns({"bx": bin_of(F.col(x), x_edges, True), "by": bin_of(F.col(y), y_edges, True)}).where("bx IS NOT NULL AND by IS NOT NULL")
    counted = rows.groupBy(*groups, "bx", "by").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def density_levels(hist: DataFrame, groups: list[str], enclosed: tuple[float, ...] = (0.95, 0.68, 0.40), steps: int = 20) -> DataFrame:
    """(groups, level, threshold): the densities above which the given shares of a histogram lie.

    20 thresholds from 0 to the highest share; of those that enclose the same the
    lowest counts; between them linear, beyond them the end; level 1 closes the list at 1.
    """
    top = hist.groupBy(*groups).agg(F.max("share").alias("top"), F.min("share").alias("low"))
    steps_ = top.withColumn("t", F.explode(F.array(*[F.lit(k / (steps - 1)) for k in range(steps)]))).withColumn("t", F.col("t") * F.col("top"))
    # the histogram is small: at most the number of its cells for each group and threshold
    inside = hist.join(steps_, groups).groupBy(*groups, "t").agg(F.round(F.sum(F.when(F.col("share") >= F.col("t"), F.col("share")).otherwise(0.0)), 12).alias("share_in"))
    curve = inside.groupBy(*groups, "share_in").agg(F.min("t").alias("t"))
    points = curve.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("share_in", "t"))).alias("c")).withColumn("level", F.explode(F.array(*[F.lit(e) for e in enclosed])))
    below, above = F.filter("c", lambda p: p["share_in"] <= F.col("level")), F.filter("c", lambda p: p["share_in"] >= F.col("level"))
    lo, hi = F.element_at(F.when(F.size(below) > 0, below), -1), F.element_at(F.when(F.size(above) > 0, above), 1)
    mix = lo["t"] + F.coalesce(F.try_divide((F.col("level") - lo["share_in"]) * (hi["t"] - lo["t"]), hi["share_in"] - lo["share_in"]), F.lit(0.0))
    levels = points.select(*groups, "level", F.coalesce(mix, lo["t"], hi["t"]).alias("threshold"))
    flat = top.where("low = top").select(*groups, F.explode(F.array(*[F.struct(F.lit(e).alias("level"), (F.col("top") * e).alias("threshold")) for e in enclosed])).alias("p")).select(*groups, "p.*")
    uneven = levels.join(top.where("low < top").select(*groups), groups, "left_semi") if groups else levels
    closing = top.select(*groups, F.lit(1.0).alias("level"), F.lit(1.0).alias("threshold"))
    return uneven.unionByName(flat).unionByName(closing)


def extents(df: DataFrame, groups: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(groups, n, min_<axis>, max_<axis>): the range of the positions."""
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *[f(known(a)).alias(f"{name}_{a}") for a in axes for name, f in (("min", F.min), ("max", F.max))])


def calibration_summary(df: DataFrame, groups: list[str], mass: str) -> DataFrame:
    """(groups, n, n_known, known_share, mean_log, std_log, mean, median) of a mass column."""
    rows = df.select(*groups, F.when(finite(F.col(mass)) & (F.col(mass) > 0), F.col(mass)).alias("_m"))
    m = F.col("_m")
    plain = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count(m).alias("n_known"), (F.count(m) / F.count("*")).alias("known_share"),
        F.avg(F.log10(m)).alias("mean_log"), F.stddev_pop(F.log10(m)).alias("std_log"), F.avg(m).alias("mean"),
    )
    return beside(plain, quantiles(rows, groups, "_m", {"median": 0.5}).drop("n"), groups)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows are pre-aggregated, so a hot key is no hot task. Nulls order first."""
    names = [f"_o{k}" for k in range(len(order))]
    rest = [c for c in df.columns if c not in key]
    picked = df.select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)]).groupBy(*key).agg(F.min(F.struct(*names, *rest)).alias("_r"))
    return picked.select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def curve_ratio(curve: DataFrame, reference: DataFrame, groups: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(groups, x, ratio): a curve over a reference curve linear between its points, null outside of them."""
    ahead = Window.partitionBy(*groups).orderBy(x)
    spans = reference.select(*groups, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(ahead).alias("x1"), F.lead(y).over(ahead).alias("y1"))
    spans = spans.groupBy(*groups).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("spans"))  # a curve has as many points as bins
    met = curve.join(spans, groups, "left").withColumn("s", F.get(F.filter("spans", lambda s: (s["x0"] <= F.col(x)) & ((F.col(x) < s["x1"]) | (F.col(x) == s["x0"]) | (F.col(x) == s["x1"]))), F.lit(0)))
    at = F.coalesce(F.col("s.y0") + (F.col(x) - F.col("s.x0")) * F.try_divide(F.col("s.y1") - F.col("s.y0"), F.col("s.x1") - F.col("s.x0")), F.when(F.col(x) == F.col("s.x0"), F.col("s.y0")))
    return met.select(*groups, x, F.try_divide(F.col(y), at).alias("ratio"))


def covariances(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """(groups, n, median_<c>, cov_<a>_<b>): medians and sample covariances over rows in which all columns are known."""
    rows = df.na.drop(subset=columns)
    for c in columns:
        rows = rows.where(finite(F.col(c)))
    pairs = [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for k, a in enumerate(columns) for b in columns[k:]]
    out = rows.groupBy(*groups).agg(F.count("*").alias("n"), *pairs)
    for c in columns:
        out = beside(out, quantiles(rows, groups, c, {f"median_{c}": 0.5}).drop("n"), groups)
    return out
