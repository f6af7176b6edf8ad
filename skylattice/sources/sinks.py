"""Writers of tables, descriptor texts, curves, samples and manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.filters import in_sub_box, shifted
from skylattice.sources.catalogs import DESCRIPTOR_COLUMNS


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """Parquet, optionally in folders by column; an existing table is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def write_text(df: DataFrame, path: str, columns: list[str], header: str | None = None) -> str:
    """Rows as text, fields parted by a blank; nulls as nan; an optional comment on top of each file."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]
    lines = df.select(F.concat_ws(" ", *fields).alias("value"))
    if header:
        top = df.sparkSession.createDataFrame([(f"# {header}",)], "value string")
        lines = top.coalesce(1).unionByName(lines)
    lines.write.mode("overwrite").text(path)
    return path


def write_descriptors(df: DataFrame, path: str, mass: bool = True, radius: bool = True) -> str:
    """A descriptor text with the wanted column groups. Raises if one is missing."""
    columns = [c for c in DESCRIPTOR_COLUMNS if (mass or c != "descriptor_m200b") and (radius or c != "halo_rg")]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing} to write")
    return write_text(df, path, columns, " ".join(columns))


def write_grid(grid: DataFrame, path: str, info: dict) -> str:
    """A grid and, beside it, one row of typed metadata."""
    write_table(grid, f"{path}/grid")
    spark = grid.sparkSession
    row = {"box_size": float(info["box_size"]), "n_grid": int(info["n_grid"]), "n_particles": int(info["n_particles"]), "mass_particle": float(info["mass_particle"]), "process_duration": info.get("process_duration")}
    write_table(spark.createDataFrame([tuple(row.values())], "box_size double, n_grid int, n_particles long, mass_particle double, process_duration double").coalesce(1), f"{path}/info")
    return path


def read_grid(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/grid"), spark.read.parquet(f"{path}/info").first().asDict()


def grid_name(path: str) -> str:
    """The name of a particle source: its file or folder, or the parent of a numbered block."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return os.path.basename(os.path.dirname(path.rstrip("/"))) if stem.isdigit() else stem


def write_tensors(tensors: DataFrame, path: str) -> str:
    """Tensors as float, in one folder for each scale."""
    keep = [F.col(c).cast("float").alias(c) if c.startswith("t") else F.col(c) for c in tensors.columns]
    return write_table(tensors.select(*keep), path, ["scale"])


def write_curves(df: DataFrame, path: str) -> str:
    """A small table of curves as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(path: str, values: dict) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(values, f, indent=1, sort_keys=True, default=str)
    return path


def update_manifest(path: str, entry: dict) -> dict:
    """Insert or replace the entry of its name in a manifest."""
    known = {}
    if os.path.exists(path):
        with open(path) as f:
            known = json.load(f)
    known[entry["name"]] = entry
    write_json(path, known)
    return known


def spatial_sample(df: DataFrame, low: tuple, high: tuple, path: str, name: str, manifest: str | None = None) -> DataFrame:
    """Write the rows of a closed box as a table, with their number in the manifest."""
    write_table(df.where(in_sub_box(low, high, closed=True)), path)
    out = df.sparkSession.read.parquet(path)
    if manifest:
        update_manifest(manifest, {"name": name, "low": list(low), "high": list(high), "rows": out.count(), "path": path})
    return out


def recentred_copy(df: DataFrame, origin: tuple, path: str) -> DataFrame:
    """Write the rows with positions relative to a new origin, to a new path."""
    write_table(shifted(df, origin), path)
    return df.sparkSession.read.parquet(path)


def box_header(line: str, side: float) -> str:
    """A header line with the box size replaced."""
    import re

    return re.sub(r"(?i)(box[ _]?size\s*[:=]\s*)[-+0-9.eE]+", rf"\g<1>{side:g}", line)
