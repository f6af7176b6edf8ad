"""Incremental ingest of catalogues and particles, and grids that grow with them.

A file stream with a checkpoint resumes where it stopped, as byte offsets did;
a deposit is a sum, so its state is one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.grid import cloud_in_cell
from skylattice.sources.catalogs import LAYOUTS, text_rows


def halo_stream(spark: SparkSession, folder: str, layout: str = "hlist", files_per_batch: int = 1) -> DataFrame:
    """The halos of a folder of catalogue texts as they arrive."""
    where = LAYOUTS[layout]
    picked = {c: where[c] for c in ("id", "pid", "x", "y", "z", "m200b") if c in where}
    return text_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), picked).where("id IS NOT NULL")


def particle_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """x, y, z of a folder of particle texts as they arrive."""
    return text_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), {"x": 0, "y": 1, "z": 2}, ()).where("z IS NOT NULL")


def deposit_stream(points: DataFrame, n: int, side: float, weight: str | None = None) -> DataFrame:
    """The running cloud-in-cell grid of a point stream, for output mode complete or update."""
    return cloud_in_cell(points.withColumns({"box": F.lit(0), "side": F.lit(float(side))}), n, weight)


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream to Parquet exactly once, all that is there now; returns the finished query."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
