"""Reader of column-block folders, in which each block is a folder of raw numbers with a text header.

A block ``name`` holds ``header`` (lines ``DTYPE: <f8``, ``NMEMB: 3``, ``NFILE: n``
and ``000000: count : ...``) and numbered files of raw rows. Attributes stand in
``attr-v2`` as ``name dtype n hex``. Row ranges are read side by side.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def block_header(path: str) -> tuple[np.dtype, int, list[int]]:
    """(dtype, members of a row, rows of each file) of a block."""
    values, sizes = {}, []
    with open(os.path.join(path, "header")) as f:
        for line in f:
            name, _, value = line.partition(":")
            if name.strip().upper() in ("DTYPE", "NMEMB", "NFILE"):
                values[name.strip().upper()] = value.strip()
            elif value:
                sizes.append(int(value.split(":")[0]))
    return np.dtype(values["DTYPE"]), int(values.get("NMEMB", 1)), sizes


def attributes(path: str) -> dict[str, float]:
    """The numbers among the attributes of a block."""
    found = {}
    with open(os.path.join(path, "attr-v2")) as f:
        for line in f:
            parts = line.split()
            if len(parts) >= 4 and np.dtype(parts[1]).kind in "fiu":
                found[parts[0]] = float(np.frombuffer(bytes.fromhex(parts[3]), dtype=parts[1])[0])
    return found


def read_rows(path: str, start: int, stop: int) -> np.ndarray:
    """Rows start to stop of a block, over its files."""
    dtype, members, sizes = block_header(path)
    parts, first = [], 0
    for k, size in enumerate(sizes):
        lo, hi = max(start, first), min(stop, first + size)
        if lo < hi:
            name = next(n for n in (f"{k:06X}", f"{k:06x}") if os.path.exists(os.path.join(path, n)))
            with open(os.path.join(path, name), "rb") as f:
                f.seek((lo - first) * members * dtype.itemsize)
                parts.append(np.fromfile(f, dtype=dtype, count=(hi - lo) * members))
        first += size
    return np.concatenate(parts).reshape(-1, members) if parts else np.empty((0, members), dtype)


class BlockRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class BlockReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.root, self.rows = options["path"], int(options.get("rowsPerPartition", 1_000_000))
        self.blocks = [b.partition(":")[::2] for b in options["blocks"].split(",")]

    def partitions(self) -> list[BlockRange]:
        total = sum(block_header(os.path.join(self.root, self.blocks[0][0]))[2])
        return [BlockRange(k, min(k + self.rows, total)) for k in range(0, total, self.rows)] or [BlockRange(0, 0)]

    def read(self, partition: BlockRange) -> Iterator:
        import pyarrow as pa

        for start in range(partition.start, partition.stop, 100_000):
            stop, columns = min(start + 100_000, partition.stop), {"row_id": np.arange(start, min(start + 100_000, partition.stop), dtype=np.int64)}
            for block, names in self.blocks:
                values = read_rows(os.path.join(self.root, block), start, stop)
                for k, name in enumerate(names.split("/")):
                    columns[name] = values[:, k].astype(np.int64 if values.dtype.kind in "iu" else np.float64)
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


class BlockSource(DataSource):
    """Format ``columnblocks``: options path, blocks ("Position:x/y/z,ID:id") and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "columnblocks"

    def schema(self) -> str:
        fields = ["row_id long"]
        for spec in self.options["blocks"].split(","):
            block, _, names = spec.partition(":")
            kind = "long" if block_header(os.path.join(self.options["path"], block))[0].kind in "iu" else "double"
            fields += [f"{n} {kind}" for n in names.split("/")]
        return ", ".join(fields)

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(schema, self.options)


def blocks(spark: SparkSession, path: str, spec: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(BlockSource)
    return spark.read.format("columnblocks").option("blocks", spec).option("rowsPerPartition", rows_per_partition).load(path)


def linked_halos(spark: SparkSession, path: str, header: str = "Header", rows_per_partition: int = 1_000_000) -> DataFrame:
    """(row_id, id, length, x, y, z, m200b): halos of linked particles; the mass is length times the unit mass in Msun/h."""
    known = attributes(os.path.join(path, header))
    unit = known["UnitMass_in_g"] / 1.989e33 / known["HubbleParam"]
    return blocks(spark, path, "ID:id,Length:length,Position:x/y/z", rows_per_partition).withColumn("m200b", F.col("length") * unit)


def block_particles(spark: SparkSession, path: str, group: str = "1", rows_per_partition: int = 1_000_000) -> DataFrame:
    """(row_id, x, y, z) of the particles of a group."""
    return blocks(spark, os.path.join(path, group), "Position:x/y/z", rows_per_partition)
