"""Scans of text catalogues, particles and descriptor files, and what their headers say.

Rows are parsed with built-in functions from one text scan that projects all
wanted columns at once; comments, blank and short rows are skipped, values that
are no numbers are null. bz2 files are read in place.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the 0-based columns of the two text layouts
LAYOUTS: dict[str, dict[str, int]] = {
    "hlist": {"id": 1, "pid": 5, "rvir": 11, "x": 17, "y": 18, "z": 19, "spin": 26, "rs": 37, "m200b": 39, "ba": 46, "ca": 47, "t_over_u": 56},
    "list": {"id": 0, "x": 8, "y": 9, "z": 10, "m200b": 20, "t_over_u": 37, "pid": 40},
}
# fixed values: the columns of a descriptor file
DESCRIPTOR_COLUMNS = ("descriptor_halo_id", "cell_x", "cell_y", "cell_z", "descriptor_m200b", "halo_rg", "tidal_anisotropy", "overdensity")
DESCRIPTOR_FILE = r"^(\d+)_halo_environment_descriptors\.txt$"
# fixed values: the spellings of the cosmology in headers; blanks count as underscores, and any name that begins like the last two is meant
COSMOLOGY_KEYS = {"om": "om", "ol": "ol", "h": "h", "h0": "h"}
COSMOLOGY_BEGINNINGS = {"omega_m": "om", "omega_l": "ol"}


def cosmology_key(name: str) -> str | None:
    """om, ol or h for a name in a header, else None."""
    plain = name.strip().lower().replace(" ", "_")
    return COSMOLOGY_KEYS.get(plain) or next((v for k, v in COSMOLOGY_BEGINNINGS.items() if plain.startswith(k)), None)


@dataclass
class Header:
    """What the comment lines at the top of a catalogue say."""

    lines: list[str] = field(default_factory=list)
    width: int | None = None

    def cosmology(self) -> dict[str, float] | None:
        """om, ol and h, in any spelling; None unless all three are there."""
        found: dict[str, float] = {}
        for line in self.lines:
            for part in line.lstrip("#").split(";"):
                name, _, value = part.partition("=")
                known = cosmology_key(name)
                try:
                    if known:
                        found[known] = float(value)
                except ValueError:
                    continue
        return found if set(found) == {"om", "ol", "h"} else None

    def columns(self) -> dict[str, int]:
        """Column names, in lower case, to positions, of a line like ``#ID X Y`` or ``#name(0) name(1)``."""
        for line in self.lines:
            numbered = re.findall(r"(\S+?)\((\d+)\)", line.lstrip("#"))
            if numbered and line.lstrip("#").split()[0].endswith("(0)"):
                return {name.lower(): int(k) for name, k in numbered}
            names = line.lstrip("#").split()
            if line.startswith("#") and names and names[0].lower() == "id":
                return {name.lower(): k for k, name in enumerate(names)}
        return {}

    def pid_column(self) -> int | None:
        """Where the parent id stands: by name, or in the place of short rows where they end before that."""
        named = self.columns().get("pid")
        short = LAYOUTS["list"]["pid"]
        return short if self.width is not None and self.width <= (named if named is not None else -1) else named


def read_header(spark: SparkSession, path: str) -> Header:
    """The leading comments, however many, and the number of columns of the first row; read on the driver."""
    n = 256
    while True:
        top = [r.value for r in spark.read.text(path).limit(n).collect()]
        comments = []
        for line in top:
            if line.startswith("#"):
                comments.append(line)
            elif line.strip():
                return Header(comments, len(line.split()))
        if len(top) < n:
            return Header(comments)
        n *= 4


def host_filter(header: Header, wanted: bool | None, default: int | None = None) -> int | None:
    """The column to filter hosts by, or None for no filter.

    ``wanted`` False never filters; None filters where the header names a parent
    column. True filters by that column; a catalogue that names its columns but
    no parent raises, one without names takes ``default`` with a warning, and
    raises without a default.
    """
    if wanted is False:
        return None
    column = header.pid_column()
    if column is not None or not wanted:
        return column
    if default is None or header.columns():
        raise ValueError("the catalogue has no pid column to filter hosts by")
    warnings.warn(f"the catalogue names no columns; hosts are filtered by column {default}", stacklevel=2)
    return default


def text_rows(df: DataFrame, columns: dict[str, int], longs: tuple[str, ...] = ("id", "pid")) -> DataFrame:
    """Lines in ``value`` to typed columns; comments and blank lines are dropped, missing fields are null."""
    lines = df.select(*[c for c in df.columns if c != "value"], F.trim(F.regexp_replace("value", r"\s+", " ")).alias("_v")).where((F.col("_v") != "") & ~F.col("_v").startswith("#"))
    fields = lines.withColumn("_f", F.split("_v", " "))
    number = lambda k: F.get("_f", F.lit(k)).try_cast("double")
    typed = [F.coalesce(F.get("_f", F.lit(k)).try_cast("long"), number(k).try_cast("long")).alias(c) if c in longs else number(k).alias(c) for c, k in columns.items()]
    return fields.select(*[c for c in df.columns if c != "value"], *typed)


def halo_catalog(spark: SparkSession, path: str | list[str], layout: str | dict[str, int] = "hlist", columns: list[str] | None = None, hosts: bool | None = None, limit: int | None = None) -> DataFrame:
    """A text catalogue: the wanted columns of its layout, hosts only where asked for.

    With ``limit`` exactly that many rows after the filter.
    """
    where = LAYOUTS[layout] if isinstance(layout, str) else layout
    picked = {c: where[c] for c in (columns or [c for c in ("id", "pid", "x", "y", "z", "m200b") if c in where])}
    column = None
    if hosts is not False:
        column = where.get("pid") if layout == "hlist" else host_filter(read_header(spark, path if isinstance(path, str) else path[0]), hosts, where.get("pid"))
    rows = text_rows(spark.read.text(path), picked | ({"_pid": column} if column is not None else {}), ("id", "pid", "_pid"))
    if column is not None:
        rows = rows.where("_pid = -1").drop("_pid")
    return rows.limit(limit) if limit is not None else rows


def training_halos(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Hosts of an hlist with cv, spin and shapes; positive mass and finite cv only."""
    rows = halo_catalog(spark, path, "hlist", ["id", "pid", "x", "y", "z", "m200b", "rvir", "rs", "spin", "ba", "ca", "t_over_u"], hosts=True)
    rows = rows.withColumn("cv", F.try_divide("rvir", "rs")).drop("rvir", "rs").where("m200b > 0 AND cv IS NOT NULL")
    return rows.limit(limit) if limit is not None else rows


def target_halos(spark: SparkSession, path: str, layout: str = "list", limit: int | None = None) -> DataFrame:
    """All halos of positive mass of a list."""
    rows = halo_catalog(spark, path, layout, [c for c in ("id", "x", "y", "z", "m200b", "t_over_u") if c in LAYOUTS[layout]], hosts=False).where("m200b > 0")
    return rows.limit(limit) if limit is not None else rows


def masses(spark: SparkSession, path: str, layout: str = "list", hosts: bool | None = None) -> DataFrame:
    """The positive masses of a catalogue; short rows are skipped."""
    return halo_catalog(spark, path, layout, ["m200b"], hosts).where("m200b > 0")


def particles(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of a particle text, further columns ignored."""
    return text_rows(spark.read.text(path), {"x": 0, "y": 1, "z": 2}, ()).where("z IS NOT NULL")


def descriptor_table(spark: SparkSession, folder: str, first_files: int | None = None) -> DataFrame:
    """All numbered descriptor files of a folder with their batch number; other files are left out."""
    lines = spark.read.text(folder).select("value", F.regexp_extract(F.col("_metadata.file_name"), DESCRIPTOR_FILE, 1).alias("b")).where("b <> ''")
    rows = text_rows(lines.select(F.col("b").cast("int").alias("batch_id"), "value"), {c: k for k, c in enumerate(DESCRIPTOR_COLUMNS)}, DESCRIPTOR_COLUMNS[:4])
    if first_files is None:
        return rows
    from pyspark.sql.window import Window

    numbers = lines.select(F.col("b").cast("int").alias("batch_id")).distinct()
    kept = numbers.withColumn("n", F.row_number().over(Window.orderBy("batch_id"))).where(F.col("n") <= first_files)
    return rows.join(kept.select("batch_id"), "batch_id", "left_semi")


def delimited(spark: SparkSession, paths: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Delimited files with a header, all columns by name, optionally renamed."""
    out = spark.read.option("header", True).option("inferSchema", True).csv(paths)
    return out.withColumnsRenamed(rename or {})


def curves(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(catalog, x, y) of a mass-function table: with a header row, or one row of x and one of y for each catalogue."""
    first = spark.read.text(path).first()
    if first is not None and re.search(r"[a-df-z_]", first.value, re.I):
        wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
        others = [c for c in wide.columns if c != wide.columns[0]]
        return wide.unpivot([wide.columns[0]], others, "catalog", "y").select("catalog", F.col(wide.columns[0]).alias("x"), F.col("y").cast("double").alias("y"))
    numbered = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.split("value", r"[,\s]+").alias("f"))
    labelled = [(k, name) for k, name in enumerate(names)]
    rows = numbered.coalesce(1).select((F.floor(F.col("n") / 2)).cast("int").alias("k"), (F.col("n") % 2).alias("part"), F.posexplode("f").alias("at", "v"))
    both = rows.groupBy("k", "at").agg(F.max(F.when(F.col("part") == 0, F.col("v").try_cast("double"))).alias("x"), F.max(F.when(F.col("part") == 1, F.col("v").try_cast("double"))).alias("y"))
    return both.join(spark.createDataFrame(labelled, "k int, catalog string"), "k").select("catalog", "x", "y")


def detect_format(path: str) -> str:
    """How particles are stored: "bigfile" for a folder, else "text"."""
    import os

    return "bigfile" if os.path.isdir(path) else "text"


def read_settings(path: str) -> dict:
    """A run configuration or manifest in JSON."""
    with open(path) as f:
        return json.load(f)


def header_cosmology(lines: DataFrame, text: str = "raw_line", key: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """(key, om, ol, h) of many files at once, from their comment lines; null where a file does not say."""

    def value(pattern: str) -> Column:
        return F.max(F.regexp_extract(F.lower(text), rf"(?:^|[#;])\s*(?:{pattern})\s*=\s*([-+0-9.e]+)", 1).try_cast(T.DoubleType()))

    return lines.where(F.col(text).startswith("#")).groupBy(*key).agg(value("om|omega[ _]m[^=;]*").alias("om"), value("ol|omega[ _]l[^=;]*").alias("ol"), value("h|h0").alias("h"))
