"""Many small texts of records to few well-sized, sorted files with range metadata.

A delivery is first written as sorted runs, whose bytes and rows are measured.
The key space is then cut into ranges of about one file each, and the runs are
merged per key range: Spark's sort within a range is an external merge, which
spills sorted runs and reads them as streams. Files roll by the bytes of a row as
measured. A table beside the data holds the key range, rows and bytes of each
file, so that readers can skip files, and a later delivery is merged only into
the files whose range it meets; the others stay as they are.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.operators.rejects import NUMBER
from skylattice.runtime import stage, staged_path
from skylattice.sources.catalogs import DESCRIPTOR_COLUMNS

RECORD_FIELDS = DESCRIPTOR_COLUMNS
RECORD_KEY = RECORD_FIELDS[:4]
# a numeric field may also be one of the words that number writers use for missing and overflow
NUMERIC = NUMBER[:-2].replace(r"\A", r"\A(?:") + r"|[+-]?(?:nan|NaN|NAN|inf|Inf|INF|infinity|Infinity))\z"


@dataclass
class Consolidated:
    """The consolidated data, the folder in which they stand, the range metadata of their files, and how they are kept."""

    rows: DataFrame
    path: str
    files: DataFrame
    key: tuple[str, ...]
    file_bytes: int
    once: bool


def whole_number(text: Column) -> Column:
    """The bigint that a numeric text denotes, however it is written, else null."""
    exact = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))
    wide = text.try_cast("decimal(38,10)")
    return F.coalesce(exact, F.when(wide == F.floor(wide), wide.try_cast("long")))


def descriptor_records(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of all texts: lines of exactly eight numeric fields.

    Lines end with LF, CRLF or CR, fields are parted by blanks or tabs. Comments,
    markers, cut-off lines and lines whose key is no whole number hold no record.
    Null and empty texts hold none. Repeated records stay, one row for each.
    """
    line = F.explode(F.split(F.col(content), r"\r\n|\n|\r", -1)).alias("line")
    lines = files.select(line).select(F.regexp_replace("line", r"\A[ \t]+|[ \t]+\z", "").alias("line")).where(F.col("line") != "")
    fields = lines.select(F.split("line", r"[ \t]+", -1).alias("f")).where(F.size("f") == len(RECORD_FIELDS))
    numeric = fields.where(F.forall("f", lambda x: x.rlike(NUMERIC)))
    keys = [whole_number(F.get("f", F.lit(k))).alias(c) for k, c in enumerate(RECORD_KEY)]
    rest = [F.get("f", F.lit(k + 4)).try_cast("double").alias(c) for k, c in enumerate(RECORD_FIELDS[4:])]
    records = numeric.select(*keys, *rest)
    for c in RECORD_KEY[1:]:
        records = records.withColumn(c, F.col(c).try_cast("int"))
    return records.na.drop(subset=list(RECORD_KEY))


def _least(records: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row for each key, the one with the least other columns; combined before any shuffle, so that copies do not meet in bulk."""
    others = [c for c in records.columns if c not in key]
    least = F.min(F.struct(*others)).alias("rest") if others else F.count("*").alias("rest")
    return records.groupBy(*key).agg(least).select(*key, *([f"rest.{c}" for c in others]))


def _merged(rows: DataFrame, key: tuple[str, ...], n_bytes: int, n_rows: int, file_bytes: int, once: bool, path: str, slot: str | None = None) -> DataFrame:
    """Merge sorted runs into files of about ``file_bytes`` below ``path``, no file over several values of ``slot``, and give their range metadata."""
    ranges, row_bytes = max(1, math.ceil(n_bytes / file_bytes)), max(1.0, n_bytes / max(1, n_rows))
    # where duplicates stay, the ranges are cut within a key too, so that a hot key is no hot task
    copy = "_".join(["copy", *rows.columns])
    numbered = rows if once else rows.withColumn(copy, F.monotonically_increasing_id())
    merged = numbered.repartitionByRange(ranges, *key, *([] if once else [copy])).sortWithinPartitions(*([slot] if slot else []), *key).drop(copy)
    # a range that came out too large rolls to a further file, still in key order
    writer = merged.write.option("maxRecordsPerFile", max(1, int(file_bytes / row_bytes)))
    (writer.partitionBy(slot) if slot else writer).parquet(path)
    return file_ranges(rows.sparkSession.read.schema(rows.drop(*([slot] if slot else [])).schema).parquet(path), key)


def _run(records: DataFrame, key: tuple[str, ...], once: bool) -> tuple[DataFrame, int, int]:
    """A delivery written as sorted runs: (its rows, their bytes on disk, their number)."""
    spark, path = records.sparkSession, staged_path(records.sparkSession, "runs")
    if once:
        records = _least(records, key)
    records.sortWithinPartitions(*key).write.parquet(path)
    rows = spark.read.schema(records.schema).parquet(path)
    size = file_ranges(rows, key).agg(F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("n")).first()
    return rows, size.b or 0, size.n or 0


def _kept(files: DataFrame, schema, path: str, key: tuple[str, ...], file_bytes: int, once: bool) -> Consolidated:
    """Write the range metadata as a new version beside the data, and open the files that they name."""
    spark, version = files.sparkSession, f"{path}/ranges-{uuid.uuid4().hex}"
    files.coalesce(1).write.parquet(version)
    files = spark.read.schema(files.schema).parquet(version)
    names = [r.file_name for r in files.select("file_name").collect()]  # one for each file of file_bytes
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return Consolidated(rows, path, files, key, file_bytes, once)


def consolidate(records: DataFrame, key: tuple[str, ...], file_bytes: int = 128 << 20, once: bool = True, path: str | None = None) -> Consolidated:
    """Write ``records`` as few sorted files of about ``file_bytes`` with range metadata.

    once: rows with equal keys become one row, the one with the least other
    columns. Else all duplicates are preserved, and those of one key may spread
    over several files. Null keys sort first and count as equal. An empty input
    gives one empty data set and no files.
    """
    path = path or staged_path(records.sparkSession, "consolidated")
    run, n_bytes, n_rows = _run(records, key, once)
    files = _merged(run, key, n_bytes, n_rows, file_bytes, once, f"{path}/data-{uuid.uuid4().hex}")
    return _kept(files, records.schema, path, key, file_bytes, once)


def _placed(files: DataFrame, records: DataFrame, key: tuple[str, ...], slot: str) -> DataFrame:
    """The records with the file in whose range they fall as ``slot``: the last that begins at or before them, else the first; null without files.

    Files and records are sorted as one by range partitions; the last file of
    each partition, one small row, is carried on to the next.
    """
    begins = files.select(*[F.col(f"min_{c}").alias(c) for c in key], F.col("file_name").alias(slot))
    rows = records.withColumn(slot, F.lit(None).cast("string")).unionByName(begins, allowMissingColumns=True)
    part = f"part_{slot}"
    parts = stage(rows.repartitionByRange(*[F.asc_nulls_first(c) for c in key]).withColumn(part, F.spark_partition_id()), "parts")
    begun = F.last(slot, ignorenulls=True).over(Window.partitionBy(part).orderBy(*[F.asc_nulls_first(c) for c in key], F.desc_nulls_last(slot)))
    ends = parts.groupBy(part).agg(F.max_by(slot, F.when(F.col(slot).isNotNull(), F.struct(*key))).alias("end"))
    carried = ends.select(part, F.last("end", ignorenulls=True).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(f"carried_{slot}"))
    first = files.agg(F.min_by("file_name", F.struct(*[f"min_{c}" for c in key])).alias("first")).first().first
    found = parts.withColumn(f"begun_{slot}", begun).where(F.col(slot).isNull()).join(carried, part)
    return found.select(*records.columns, F.coalesce(f"begun_{slot}", f"carried_{slot}", F.lit(first)).alias(slot))


def deliver(held: Consolidated, records: DataFrame) -> Consolidated:
    """Merge a further delivery into consolidated data: only files whose key range it meets are written anew.

    Duplicates between old and new rows are treated as the data were made, with
    or without ``once``. The metadata are written as a new version; files that
    are no longer named stay for readers of the old one.
    """
    spark, schema, slot = records.sparkSession, held.rows.schema, "_".join(["slot", *held.rows.columns])
    run, n_bytes, n_rows = _run(records.select(*held.rows.columns), held.key, held.once)
    rows = stage(_placed(held.files, run, held.key, slot), "placed")
    met = stage(rows.select(F.col(slot).alias("file_name")).where("file_name IS NOT NULL").distinct(), "met")
    touched = held.files.join(met, "file_name", "left_semi")
    size = touched.agg(F.sum("n_bytes").alias("b"), F.sum("n_rows").alias("n")).first()
    names = [r.file_name for r in touched.select("file_name").collect()]  # one for each file of file_bytes
    if names:
        rows = rows.unionByName(spark.read.schema(schema).parquet(*names).withColumn(slot, F.col("_metadata.file_path")))
    # a name of a folder cannot be a path
    rows = rows.withColumn(slot, F.xxhash64(slot))
    rows = _least(rows, (slot, *held.key)) if held.once else rows
    merged = _merged(rows, held.key, n_bytes + (size.b or 0), n_rows + (size.n or 0), held.file_bytes, held.once, f"{held.path}/data-{uuid.uuid4().hex}", slot)
    files = held.files.join(met, "file_name", "left_anti").select(*merged.columns).unionByName(merged)
    return _kept(files, schema, held.path, held.key, held.file_bytes, held.once)


def file_ranges(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(file_name, n_bytes, n_rows, min_<key>, max_<key>): the metadata of each written file, with its whole name."""
    k = F.struct(*key)
    found = rows.groupBy(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"), F.min(k).alias("lo"), F.max(k).alias("hi"))
    return found.select("file_name", "n_bytes", "n_rows", *[F.col(f"lo.{c}").alias(f"min_{c}") for c in key], *[F.col(f"hi.{c}").alias(f"max_{c}") for c in key])
