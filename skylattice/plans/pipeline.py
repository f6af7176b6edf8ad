"""Whole runs composed of the operators: fields, features, enrichment, bias panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import cosmology as C
from skylattice.operators import conditional, environment, fields, filters, grid, regions, stats, tails
from skylattice.operators.calibration import calibrate
from skylattice.plans.config import Settings
from skylattice.runtime import stage
from skylattice.sources import sinks


def sides_of(halos: DataFrame) -> DataFrame:
    return halos.groupBy(F.col("box").alias("space")).agg(F.max("side").alias("side"))


def overdensity_of(points: DataFrame, n: int, weight: str | None = None, saved: str | None = None) -> DataFrame:
    """The overdensity on the full grid: a saved grid where there is one, else a deposit of the points."""
    if saved is not None:
        return points.sparkSession.read.parquet(saved)
    return grid.full_grid(grid.overdensity(grid.cloud_in_cell(points, n, weight), n), n, -1.0)


def tidal_descriptors(halos: DataFrame, settings: Settings, saved_tensors: str | None = None) -> DataFrame:
    """``halos`` with tidal_anisotropy and overdensity, null where their radius is outside the scales."""
    n, scales = settings.grid.n, list(settings.grid.scales)
    if saved_tensors is not None:
        tensors = halos.sparkSession.read.parquet(saved_tensors)
    else:
        tensors = fields.tidal_tensors(overdensity_of(halos, n), sides_of(halos), n, scales, settings.grid.physical)
    radius = C.gaussian_radius(C.r200b(F.col("m200b"), F.col("om"), F.col("h")))
    placed = grid.nearest_cells(grid.placed(halos), n).withColumns({"space": F.col("box"), "rg": radius})
    got = environment.descriptors(placed, tensors, scales).select("id", "tidal_anisotropy", "overdensity")
    return halos.join(got, "id", "left")


def with_environment(halos: DataFrame) -> DataFrame:
    """Add env, log10(1 + neighbours within the run's radius)."""
    near = regions.near_counts(halos, regions.near_pairs(halos.withColumn("reach", F.col("env_radius")), "id", "box"), "id")
    return halos.join(near.select("id", F.log10(1 + F.col("n_near")).alias("env")), "id", "left")


def feature_tables(high: DataFrame, low: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(training, target) tables: features, then the mass filter, then finite features, then calibration.

    Raises if a column is missing or a table ends up empty.
    """
    stages = {
        "log10_m200b": filters.with_log_mass,
        "env": with_environment,
        "tidal_anisotropy": lambda df: tidal_descriptors(df, settings),
    }
    out = []
    for halos in (filters.positive_mass(high), filters.positive_mass(low)):
        made = filters.attach(halos, [f for f in settings.features if f not in halos.columns], stages)
        made = filters.mass_range(made, settings.mass_filter.low, settings.mass_filter.high)
        out.append(stage(filters.finite_features(made, settings.features), "features"))
    train, target = out
    target = calibrate(target, train, settings.calibration)
    filters.require(train, ["id", "m200b", *settings.features, *settings.properties], "training table", not_empty=True)
    filters.require(target, ["id", "m200b", "m200b_cal", *settings.features], "target table", not_empty=True)
    return train, stage(target, "target")


@dataclass
class Run:
    """What a run made; parts that were switched off are None."""

    training: DataFrame | None = None
    target: DataFrame | None = None
    enriched: DataFrame | None = None
    held_out: DataFrame | None = None
    bias: DataFrame | None = None


def enriched(train: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    """The target with predicted properties. Raises if no halo got any."""
    heaviest = train.agg(F.max(F.log10("m200b"))).first()[0]
    edges = settings.edges(heaviest)
    rows = target.withColumn("mass_used", F.coalesce("m200b_cal", "m200b"))
    out = stage(conditional.enrich(rows, train, edges, list(settings.features), list(settings.properties), "id", "mass_used", settings.min_rows, settings.seed), "enriched")
    if out.where(F.col(settings.properties[0]).isNotNull()).isEmpty():
        raise ValueError("no target halo received predictions")
    return out


def bias_panel(high: DataFrame, low: DataFrame, settings: Settings) -> DataFrame:
    """(catalog, bin, tail, n, mean_bias, sem): bias of the joint tails; both catalogues use the limits of the first."""
    n, edges = settings.grid.n, settings.edges(15.0)
    properties = list(settings.properties)
    limits, parts = None, []
    for name, halos in (("high", high), ("low", low)):
        rows = conditional.with_bin(filters.require(halos, ["id", "m200b", *properties], f"{name} table"), edges).where("bin IS NOT NULL")
        bias = fields.halo_bias(halos, overdensity_of(halos, n), sides_of(halos), n, settings.assembly_bias.k_max).withColumnRenamed("v", "bias")
        rows = stage(rows.join(bias, "id"), "bias")
        if limits is None:
            limits = stage(tails.tail_limits(rows, ["bin"], properties, tails.joint_percentile(rows, ["bin"], properties, "id", settings.assembly_bias.share)), "limits")
        centers = [10**m for m in C.midpoints(edges)]
        center = F.get(F.array(*[F.lit(c) for c in centers]), F.col("bin"))
        parts.append(tails.bias_curves(tails.in_tails(rows, limits, ["bin"], properties), ["bin"], "bias", center).withColumn("catalog", F.lit(name)))
    return parts[0].unionByName(parts[1])


def run(high: DataFrame, low: DataFrame, settings: Settings, folder: str | None = None) -> Run:
    """The stages that are switched on, in order; with a folder, the tables are written below it."""
    made = Run()
    if settings.assembly_bias.only:
        made.bias = bias_panel(high, low, settings)
        return made
    if settings.tidal:
        high, low = (stage(tidal_descriptors(h, settings), "tidal") for h in (high, low))
    if settings.preprocess:
        made.training, made.target = feature_tables(high, low, settings)
        if folder:
            sinks.write_table(made.training, f"{folder}/training")
            sinks.write_table(made.target, f"{folder}/target")
    if settings.enrichment and made.training is not None:
        if settings.hold_out:
            heaviest = made.training.agg(F.max(F.log10("m200b"))).first()[0]
            made.held_out = conditional.hold_out(made.training, settings.edges(heaviest), list(settings.features), list(settings.properties), "id", min_rows=settings.min_rows)
        made.enriched = enriched(made.training, made.target, settings)
        if folder:
            sinks.write_table(made.enriched, f"{folder}/enriched")
        if settings.assembly_bias.enabled:
            made.bias = bias_panel(made.training, made.enriched, settings)
    return made


def mass_functions(high: DataFrame, low: DataFrame, edges: list[float], min_particles: int = 0) -> DataFrame:
    """Mass functions of two catalogues side by side, after a cut in particles."""
    parts = [filters.min_particles(h, min_particles, F.col("mp")).select(F.lit(n).alias("catalog"), "m200b") for n, h in (("high", high), ("low", low))]
    return stats.pivoted(stats.mass_function(parts[0].unionByName(parts[1]), edges, ["catalog"]), "catalog", ["high", "low"], "n")
