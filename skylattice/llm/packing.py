"""Filling containers of fixed capacity with items, by sum-of-squares online packing.

A level array holds how many open containers are filled to each level. An item
goes to the level that leaves the sum of the squared counts smallest, which
keeps the open containers few and of varied levels. Items are dealt into blocks
that are packed side by side; the items of the containers that stay open are
packed once more together, in far fewer blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import stage

BLOCK_ITEMS = 20_000
#: tasks that share the blocks of a round
MOST_TASKS = 20_000
LAYOUT = "pack_id int, container_id string, item_id long, start_token long, n_tokens long, capacity long, closed boolean"


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, level of each container) for sizes from 1 to the capacity, in the order given."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, levels = np.empty(len(sizes), dtype=np.int64), []
    for k, size in enumerate(map(int, sizes)):
        at = np.flatnonzero(counts[1 : capacity - size + 1]) + 1
        level = 0
        if len(at):
            # moving a container from h to h + size changes the sum by this; a full one no longer counts
            change = np.where(at + size < capacity, 2 * counts[at + size] + 1, 0) - 2 * counts[at] + 1
            best = len(at) - 1 - int(change[::-1].argmin())  # of equal changes the fullest container
            if change[best] <= (2 * counts[size] + 1 if size < capacity else 0):
                level = int(at[best])
        if level:
            container = open_[level].pop()
            counts[level] -= 1
        else:
            container = len(levels)
            levels.append(0)
        levels[container] = level + size
        placed[k] = container
        if level + size < capacity:
            counts[level + size] += 1
            open_[level + size].append(container)
    return placed, np.array(levels, dtype=np.int64)


def _packed(items: DataFrame, round_: int, block_items: int) -> DataFrame:
    """One round: items are dealt into blocks of about ``block_items`` and packed block by block."""
    many = items.groupBy("pack_id").agg(F.ceil(F.count("*") / block_items).alias("blocks"))
    dealt = items.join(many, "pack_id").withColumn("block", F.pmod(F.xxhash64("item_id", "start_token", F.lit(round_)), F.col("blocks")))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "item_id", "start_token"], ignore_index=True)
        capacity = int(group.capacity.iloc[0])
        container, levels = pack(group.n_tokens.to_numpy(), capacity)
        names = np.array([f"{round_}-{group.block.iloc[0]}-{c}" for c in range(len(levels))], dtype=object)
        return group[["pack_id", "item_id", "start_token", "n_tokens", "capacity"]].assign(container_id=names[container], closed=levels[container] == capacity)[["pack_id", "container_id", "item_id", "start_token", "n_tokens", "capacity", "closed"]]

    # a block is much work in few bytes: a task for each, where small partitions would be joined by their bytes
    tasks = max(1, min(MOST_TASKS, many.agg(F.sum("blocks").alias("n")).first().n or 1))
    ordered = dealt.withColumn("order", F.xxhash64("start_token", "item_id")).select("pack_id", "block", "order", "item_id", "start_token", "n_tokens", "capacity")
    return ordered.repartition(tasks, "pack_id", "block").groupBy("pack_id", "block").applyInPandas(fill, LAYOUT)


def layout(items: DataFrame, id_: str, size: str, capacities: dict[int, int], block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(pack_id, container_id, item_id, start_token, n_tokens, capacity): where every part of every item lies.

    ``capacities`` names the few kinds of container. Only an item above the
    capacity is cut, into full containers and one rest that is packed with the
    others. Items of null, zero or negative size take no room and have no row;
    rows that repeat an id are items of their own. Capacities below 1 are left out.
    """
    kinds = [(int(k), int(c)) for k, c in sorted(capacities.items()) if c is not None and c >= 1]
    if not kinds:
        return items.sparkSession.createDataFrame([], LAYOUT).drop("closed")
    packs = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])).alias("p")
    wanted = items.where(F.col(size) > 0).select(F.col(id_).cast("long").alias("item_id"), F.col(size).cast("long").alias("size"), packs).select("item_id", "size", "p.*")
    whole = F.floor(F.col("size") / F.col("capacity"))
    rest = wanted.withColumn("start_token", whole * F.col("capacity")).withColumn("n_tokens", F.col("size") - F.col("start_token")).where("n_tokens > 0")
    full = wanted.where("size >= capacity").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    full = full.select(
        "pack_id", F.concat_ws("-", F.lit("full"), "item_id", "part").alias("container_id"), "item_id",
        (F.col("part") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"), "capacity",
    )
    first = stage(_packed(rest.select("pack_id", "capacity", "item_id", "start_token", "n_tokens"), 1, block_items), "packed")
    again = _packed(first.where("NOT closed").select("pack_id", "capacity", "item_id", "start_token", "n_tokens"), 2, block_items)
    return full.unionByName(first.where("closed").drop("closed")).unionByName(again.drop("closed"))


def fill_report(laid: DataFrame) -> DataFrame:
    """(pack_id, n_containers, n_tokens, fewest_containers, fill_share): the room used in each kind of container."""
    # each container's parts are summed first, so that counting containers needs no distinct
    held = laid.groupBy("pack_id", "container_id", "capacity").agg(F.sum("n_tokens").alias("n"))
    found = held.groupBy("pack_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return found.select("pack_id", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("fewest_containers"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill_share"))
