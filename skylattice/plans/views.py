"""The halo tables as the operators want them: each halo once, positions inside the box, NaN as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.filters import wrapped
from skylattice.runtime import finite, table

RUN_COLUMNS = {
    "boxsize_mpc_h": "side", "r_match_mpc_h": "r_match", "env_radius_mpc_h": "env_radius", "max_mass_distance": "max_mass_distance",
    "omega_matter": "om", "h0": "h", "mass_particle": "mp",
}


def _clean(column: str):
    return F.max(F.when(finite(F.col(column)), F.col(column)))


def _halos(spark: SparkSession, sf_dir: str, name: str, id_: str, longs: dict[str, str], doubles: tuple[str, ...]) -> DataFrame:
    rows = table(spark, sf_dir, name)
    once = rows.groupBy(F.col(id_).alias("id")).agg(
        F.max("run_id").alias("run_id"), F.max("box_id").alias("box"), *[F.max(c).alias(a) for c, a in longs.items()],
        *[_clean(f"halo_{a}").alias(a) for a in "xyz"], *[_clean(c).alias(c) for c in doubles],
    ).where("id IS NOT NULL")
    runs = table(spark, sf_dir, "sim_runs").select("run_id", *[F.col(c).alias(a) for c, a in RUN_COLUMNS.items()])
    return once.join(runs, "run_id").withColumns({a: wrapped(F.col(a), F.col("side")) for a in "xyz"})


def high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halos of the high-resolution catalogue with the settings of their run."""
    return _halos(spark, sf_dir, "hr_halos", "halo_id", {"pid": "pid"}, ("m200b", "cv", "spin", "ca", "ba"))


def low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halos of the low-resolution catalogue with the settings of their run."""
    return _halos(spark, sf_dir, "lr_halos", "lr_halo_id", {"n_part": "n_part"}, ("m200b", "spin"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (halo, day) of the descriptors once, with values that were not computed as null."""
    rows = table(spark, sf_dir, "descriptors")
    clean = lambda c: F.max(F.when(finite(F.col(c)) & (F.col(c) != -999), F.col(c))).alias(c)
    return rows.groupBy("descriptor_halo_id", "batch_day").agg(*[F.max(c).alias(c) for c in ("run_id", "cell_x", "cell_y", "cell_z")], *[clean(c) for c in ("descriptor_m200b", "halo_rg", "tidal_anisotropy", "overdensity")])


def box_sides(halos: DataFrame) -> DataFrame:
    """(space, side) of every box."""
    return halos.groupBy(F.col("box").alias("space")).agg(F.max("side").alias("side"))


_WRAP = ", ".join(f"{a} - side * floor({a} / side) AS {a}" for a in "xyz")


def _sql(name: str, source: str, id_: str, longs: str, doubles: tuple[str, ...]) -> str:
    clean = ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c} END) AS {a}" for c, a in [*[(f"halo_{x}", x) for x in "xyz"], *[(d, d) for d in doubles]])
    runs = ", ".join(f"{c} AS {a}" for c, a in RUN_COLUMNS.items())
    return (
        f"{name}_once AS (SELECT {id_} AS id, max(run_id) AS run_id, max(box_id) AS box, {longs}, {clean} FROM {source} WHERE {id_} IS NOT NULL GROUP BY 1), "
        f"{name} AS (SELECT o.* EXCLUDE (x, y, z), {_WRAP}, r.* EXCLUDE (run_id) FROM {name}_once o JOIN (SELECT run_id, {runs} FROM sim_runs) r USING (run_id))"
    )


HIGH_SQL = _sql("hr", "hr_halos", "halo_id", "max(pid) AS pid", ("m200b", "cv", "spin", "ca", "ba"))
LOW_SQL = _sql("lr", "lr_halos", "lr_halo_id", "max(n_part) AS n_part", ("m200b", "spin"))
DESCRIBED_SQL = (
    "ds AS (SELECT descriptor_halo_id, batch_day, max(run_id) AS run_id, max(cell_x) AS cell_x, max(cell_y) AS cell_y, max(cell_z) AS cell_z, "
    + ", ".join(f"max(CASE WHEN isfinite({c}) AND {c} <> -999 THEN {c} END) AS {c}" for c in ("descriptor_m200b", "halo_rg", "tidal_anisotropy", "overdensity"))
    + " FROM descriptors GROUP BY ALL)"
)
