"""Mass calibration of the low-resolution catalogue: off, by abundance, by matching, or by a model of matches."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.filters import in_sub_box, with_log_mass
from skylattice.operators.matching import match_one_to_one, transferred_mass
from skylattice.operators.ranks import abundance_match
from skylattice.runtime import finite

METHODS = ("off", "abundance", "matching", "matching_ml")


@dataclass(frozen=True)
class Calibration:
    """Settings; ``box_low`` and ``box_high`` bound the part of the volume whose matches train the model."""

    method: str = "off"
    k: int = 10
    features: tuple[str, ...] = ("log10_m200b",)
    regressor: str = "random_forest"
    trees: int = 50
    depth: int = 8
    seed: int = 7
    keep_threshold: float | None = None
    mask_unmatched: bool = False
    box_low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    box_high: tuple[float, float, float] = (float("inf"),) * 3

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown calibration {self.method}; known are {METHODS}")

    def fingerprint(self) -> str:
        """Sixteen hexadecimal digits that change with any setting."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def regressor(kind: str, label: str, out: str, settings: Calibration):
    """A tree model by name, of the size asked; extremely random trees are not in Spark, and a random forest that tries one feature a split stands for them."""
    common = {"featuresCol": "_features", "labelCol": label, "predictionCol": out, "seed": settings.seed, "maxDepth": settings.depth}
    if kind in ("random_forest", "extra_trees"):
        return RandomForestRegressor(numTrees=settings.trees, **common, **({"featureSubsetStrategy": "1"} if kind == "extra_trees" else {}))
    if kind in ("xgboost", "gradient_boosting"):
        return GBTRegressor(maxIter=settings.trees, **common)
    raise ValueError(f"unknown regressor {kind}")


def training_targets(low: DataFrame, high: DataFrame, settings: Calibration) -> DataFrame:
    """The ``low`` halos of the training box with p_match (1 or 0) and log_mass of the partner.

    Unmatched halos train with a log mass of 0, or are left out of the mass model with ``mask_unmatched``.
    """
    inside = in_sub_box(settings.box_low, settings.box_high)
    l, h = low.where(inside), high.where(inside)
    pairs = transferred_mass(l, h, match_one_to_one(h, l, settings.k))
    rows = pairs.withColumn("p_match", F.col("matched").cast("double")).withColumn("log_mass", F.log10("m200b_cal"))
    return rows if settings.mask_unmatched else rows.na.fill(0.0, ["log_mass"])


def fit_model(low: DataFrame, high: DataFrame, settings: Calibration) -> tuple[PipelineModel, PipelineModel]:
    """(mass model, match model) over the features of the training box."""
    rows = with_log_mass(training_targets(low, high, settings))
    for c in settings.features:
        rows = rows.where(finite(F.col(c)))
    assemble = VectorAssembler(inputCols=list(settings.features), outputCol="_features")
    mass = Pipeline(stages=[assemble, regressor(settings.regressor, "log_mass", "_log_mass", settings)]).fit(rows.where("log_mass IS NOT NULL"))
    keep = Pipeline(stages=[assemble, regressor(settings.regressor, "p_match", "_p_keep", settings)]).fit(rows)
    return mass, keep


MODEL_VERSION = 1


def save_model(models: tuple[PipelineModel, PipelineModel], settings: Calibration, spark: SparkSession, path: str) -> str:
    """Write both models, and beside them their version, features and the fingerprint of the settings."""
    for name, model in zip(("mass", "match"), models, strict=True):
        model.write().overwrite().save(f"{path}/{name}")
    about = {"version": MODEL_VERSION, "features": list(settings.features), "fingerprint": settings.fingerprint()}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_model(path: str, settings: Calibration, spark: SparkSession) -> tuple[PipelineModel, PipelineModel]:
    """The models of :func:`save_model`. Raises if they are of another version or were fitted with other settings."""
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    if about["version"] != MODEL_VERSION:
        raise ValueError(f"the model has version {about['version']}, not {MODEL_VERSION}")
    if about["fingerprint"] != settings.fingerprint():
        raise ValueError("the model was fitted with other settings")
    return PipelineModel.load(f"{path}/mass"), PipelineModel.load(f"{path}/match")


def load_or_fit(low: DataFrame, high: DataFrame, settings: Calibration, path: str) -> tuple[PipelineModel, PipelineModel]:
    """The models at a path, or, where none stands, models fitted now and saved there."""
    spark = low.sparkSession
    try:
        spark.read.text(f"{path}/about")
    except AnalysisException:
        models = fit_model(low, high, settings)
        save_model(models, settings, spark, path)
        return models
    return load_model(path, settings, spark)


def apply_model(low: DataFrame, models: tuple[PipelineModel, PipelineModel], settings: Calibration) -> DataFrame:
    """``low`` with m200b_cal and p_keep, null where a feature is unknown; below the threshold the mass is null."""
    rows = with_log_mass(low)
    known = F.lit(True)
    for c in settings.features:
        known = known & finite(F.col(c))
    got = models[1].transform(models[0].transform(rows.where(known)).drop("_features"))
    got = got.select("id", F.pow(F.lit(10.0), "_log_mass").alias("m200b_cal"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_p_keep")).alias("p_keep"))
    out = low.join(got, "id", "left")
    if settings.keep_threshold is not None:
        out = out.withColumn("m200b_cal", F.when(F.col("p_keep") >= settings.keep_threshold, F.col("m200b_cal")))
    return out


def calibrate(low: DataFrame, high: DataFrame, settings: Calibration, groups: tuple[str, ...] = ("run_id",), check: bool = True, model_path: str | None = None) -> DataFrame:
    """``low`` with m200b_cal, mass_calib_method, matched, hr_id and p_keep, those that don't apply null.

    The raw mass stays. A model of matches is kept at ``model_path``, if one is given. Raises if no halo at all gets a mass, on request of ``check``.
    """
    if settings.method == "off":
        out = low.withColumn("m200b_cal", F.col("m200b"))
    elif settings.method == "abundance":
        got = abundance_match(low, high, list(groups), "m200b", "id")
        out = low.join(got.select("id", F.col("matched_mass").alias("m200b_cal")), "id", "left")
    elif settings.method == "matching":
        out = transferred_mass(low, high, match_one_to_one(high, low, settings.k))
    else:
        models = fit_model(low, high, settings) if model_path is None else load_or_fit(low, high, settings, model_path)
        out = apply_model(low, models, settings)
    for c, kind in (("matched", "boolean"), ("hr_id", "bigint"), ("p_keep", "double")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    out = out.withColumn("mass_calib_method", F.lit(settings.method))
    if check and out.where(F.col("m200b_cal").isNotNull()).isEmpty():
        raise ValueError("no halo got a calibrated mass")
    return out
