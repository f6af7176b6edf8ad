"""Queries of the model operators. Draws and trees have no SQL; the tests check them by their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.cosmology import linear_grid
from skylattice.operators import conditional, regions
from skylattice.operators.calibration import Calibration, calibrate
from skylattice.operators.stats import calibration_summary
from skylattice.plans.catalog_queries import HL, _abundance_sql
from skylattice.plans.views import high, low
from skylattice.runtime import stage

FEATURES, PROPERTIES = ["log10_m200b", "env"], ["cv", "spin", "ca", "ba"]
EDGES = linear_grid(9.0, 15.0, 7)


def _with_features(halos: DataFrame) -> DataFrame:
    near = regions.near_counts(halos, regions.near_pairs(halos.withColumn("reach", F.col("env_radius")), "id", "box"), "id")
    logm = F.log10(F.when(F.col("m200b") > 0, F.col("m200b")))
    return stage(halos.join(near.select("id", F.log10(1 + F.col("n_near")).alias("env")), "id").withColumn("log10_m200b", logm), "features")


def l1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = conditional.fit(conditional.with_bin(_with_features(high(spark, sf_dir)), EDGES), FEATURES, PROPERTIES)
    rows = [(b, m.n, a, float(m.mean[k]), float(m.cov[k][k])) for b, m in sorted(models.items()) for k, a in enumerate(FEATURES + PROPERTIES)]
    return spark.createDataFrame(rows, "bin int, n long, column_name string, median_score double, variance double")


def l5_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _with_features(low(spark, sf_dir)).drop("spin")
    got = conditional.enrich(target, _with_features(high(spark, sf_dir)), EDGES, FEATURES, PROPERTIES, "id")
    return got.select("id", "bin", *PROPERTIES, "constraint_ok")


def l6_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditional.hold_out(_with_features(high(spark, sf_dir)), EDGES, FEATURES, PROPERTIES, "id")


def _calibrated(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return calibrate(low(spark, sf_dir), high(spark, sf_dir), Calibration(method))


def l7_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_calibrated(spark, sf_dir, m).select("id", "m200b_cal", "mass_calib_method", "matched", "hr_id") for m in ("off", "abundance", "matching")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def l7_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "abundance").select("id", F.round(F.log10("m200b_cal"), 6).alias("log_mass"), "mass_calib_method")


def l10_matching_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, "matching_ml").select("id", "m200b_cal", "p_keep")


def l13_compare_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_summary(l7_calibrations(spark, sf_dir), ["mass_calib_method"], "m200b_cal").drop("mean")


QUERIES = {f.__name__: f for f in (l1_fit, l5_enrich, l6_hold_out, l7_calibrations, l7_abundance, l10_matching_model)}
QUERIES["l13_compare_calibrations"] = l13_compare_calibrations
_TABLES, _CHOSEN = _abundance_sql(1.0).split("\nSELECT ", 1)
ORACLE: dict[str, str] = {"l7_abundance": f"{HL}{_TABLES}, ab AS (SELECT {_CHOSEN}) SELECT lr.id, ab.log_mass, 'abundance' AS mass_calib_method FROM lr LEFT JOIN ab ON ab.id = lr.id"}
