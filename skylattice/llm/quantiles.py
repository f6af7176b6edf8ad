"""Percentiles of very large numeric columns by mergeable relative-rank compactors.

A sketch has levels; an item on level h stands for 2^h values. A full level
protects the half of its items nearest to one tail and compacts a part of the
others: it sorts them and moves every second one up, starting with a coin toss.
The part is chosen by a counter, so that items are compacted the more rarely the
nearer they are to the protected tail. So the rank error at a percentile is a
fraction of its distance from that tail, and near the tail ranks are exact. Where
extremes on both sides matter, one sketch protects each tail, and a percentile is
read from the sketch of the nearer one. The coin depends on what a sketch is
of, so that sketches of equal size do not err alike.

With the default section size the error of a share of values is below
``SHARE_ERROR`` everywhere and falls in proportion to the distance from the
protected tail (measured in the tests). Sketches of days, runs or partitions
merge level by level, in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import finite

SECTION = 32
SHARE_ERROR = 0.005
#: a worker holds so many values before it compacts them, and as many items in its sketches before it sends these on, so its memory is bounded
BUFFER_ROWS = 1_000_000
#: the sketches of so many partitions are merged first, these then with each other, so no task merges those of all partitions
MERGE_FAN = 256


class Compactors:
    """A relative-rank sketch. ``protect`` names the tail ("high" or "low") whose ranks stay exact."""

    def __init__(self, section: int = SECTION, protect: str = "high", n: int = 0, levels: Iterable = (), counters: Iterable = (), of: object = None):
        self.section, self.sign, self.n, self.of = section, 1.0 if protect == "high" else -1.0, int(n), of
        self.levels = [np.asarray(v, dtype=float) * self.sign for v in levels] or [np.empty(0)]
        self.counters = [int(c) for c in counters] or [0]

    def _sections(self) -> int:
        return max(3, int(np.ceil(np.log2(max(2.0, self.n / self.section)))))

    def _compact(self, level: int, sections: int) -> None:
        items, counter = np.sort(self.levels[level]), self.counters[level]
        ones = (~counter & (counter + 1)).bit_length()  # trailing ones of the counter, plus one
        part = len(items) - self.section * (2 * sections - min(sections, ones))
        part -= part % 2
        coin = zlib.crc32(repr((self.of, self.n, level, counter)).encode()) >> 7 & 1
        if level + 1 == len(self.levels):
            self.levels.append(np.empty(0))
            self.counters.append(0)
        self.levels[level], up = items[part:], items[coin:part:2]
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], up])
        self.counters[level] += 1

    def _settle(self) -> Compactors:
        sections, level = self._sections(), 0
        while level < len(self.levels):
            if len(self.levels[level]) > 2 * sections * self.section:
                self._compact(level, sections)
            level += 1
        return self

    def add(self, values: np.ndarray) -> Compactors:
        self.levels[0] = np.concatenate([self.levels[0], np.asarray(values, dtype=float) * self.sign])
        self.n += len(values)
        return self._settle()

    def merge(self, others: Iterable[Compactors]) -> Compactors:
        parts = [self, *others]
        height = max(len(p.levels) for p in parts)
        self.levels = [np.concatenate([p.levels[h] for p in parts if h < len(p.levels)]) for h in range(height)]
        self.counters = [int(np.bitwise_or.reduce([p.counters[h] for p in parts if h < len(p.counters)])) for h in range(height)]
        self.n = sum(p.n for p in parts)
        return self._settle()

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels) * self.sign
        weights = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def counts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated numbers of values below and at most each point."""
        values, upto = self._weighted()
        upto = np.concatenate([[0.0], upto * (self.n / upto[-1] if len(upto) else 1)])
        return upto[np.searchsorted(values, points, "left")], upto[np.searchsorted(values, points, "right")]

    def percentiles(self, shares: np.ndarray) -> np.ndarray:
        """The values at the given shares (0 to 1); NaN for an empty sketch."""
        values, upto = self._weighted()
        if not len(values):
            return np.full(len(shares), np.nan)
        return values[np.minimum(np.searchsorted(upto, np.asarray(shares) * upto[-1], "left"), len(values) - 1)]

    def row(self) -> tuple[int, list, list]:
        return self.n, [list(v * self.sign) for v in self.levels], list(self.counters)


SKETCH = "n long, levels array<array<double>>, counters array<long>"


def counted(column: Column, missing: tuple[float, ...]) -> Column:
    """The value where it is finite and no missing-value marker, else null."""
    value = column.cast("double")
    return F.when(finite(value) & ~value.isin(*missing), value) if missing else F.when(finite(value), value)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def long_values(df: DataFrame, keys: list[str], fields: list[str], missing: tuple[float, ...] = ()) -> DataFrame:
    """(keys, field_name, value): one row for each value that counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), counted(F.col(f), missing).alias("value")) for f in fields])).alias("v")
    return df.select(*keys, pairs).select(*keys, "v.field_name", "v.value").where("value IS NOT NULL")


def sketches(df: DataFrame, keys: list[str], fields: list[str], missing: tuple[float, ...] = (), section: int = SECTION, protect: str = "high") -> DataFrame:
    """(keys, field_name, n, levels, counters): one sketch for each group and field.

    Each partition first makes sketches of its own rows; only these are shuffled
    and merged, in two steps, so a hot group costs no more than others. Null, NaN and infinite
    values and the ``missing`` markers do not count; a null key is a group of its
    own; groups without a value have no sketch; columns beside keys and fields
    are ignored.
    """
    flat = df.select(*keys, *[counted(F.col(f), missing).alias(f) for f in fields])
    names = [*keys, "field_name", "merge_part"]
    schema = ", ".join(k for k in (_kinds(df, keys), f"field_name string, merge_part int, {SKETCH}") if k)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, open_ = [], 0, {}

        def fold() -> None:
            frame = pd.concat(held, ignore_index=True)
            for key, rows in frame.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(frame)))]:
                for f in fields:
                    values = frame[f].to_numpy(dtype=float)[rows]
                    values = values[~np.isnan(values)]
                    if len(values):
                        name = (*(key if isinstance(key, tuple) else (key,)), f)
                        name = tuple(None if pd.isna(x) else x for x in name)
                        if name not in open_:
                            open_[name] = Compactors(section, protect, of=(name, number))
                        open_[name].add(values)

        def sent() -> Iterator[pd.DataFrame]:
            rows = [(*name, number // MERGE_FAN, *s.row()) for name, s in open_.items()]
            for k in range(0, len(rows), 500):
                yield pd.DataFrame(rows[k : k + 500], columns=[*names, "n", "levels", "counters"], dtype=object)
            open_.clear()

        number = TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BUFFER_ROWS:
                fold()
                held, size = [], 0
                if sum(len(v) for s in open_.values() for v in s.levels) >= BUFFER_ROWS:
                    yield from sent()
        if held:
            fold()
        yield from sent()

    return merged(merged(flat.mapInPandas(partial, schema), names, section, protect), [*keys, "field_name"], section, protect)


def _by_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of one key side by side in one partition, with the key as a text; many small groups share a task."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    return df.withColumn("group_key", text).repartition("group_key").sortWithinPartitions("group_key", *order)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The consecutive rows of each key, as one frame."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.group_key.to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].group_key.iloc[0] != key[a]:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def merged(parts: DataFrame, keys: list[str], section: int = SECTION, protect: str = "high") -> DataFrame:
    """(keys, n, levels, counters): the sketches of each group merged into one."""
    schema = f"{_kinds(parts, keys)}, {SKETCH}"

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for group in _groups(batches):
            key = [None if pd.isna(x) else x for x in group[keys].iloc[0]]
            first, *rest = (Compactors(section, protect, n, levels, counters, tuple(map(str, key))) for n, levels, counters in zip(group.n, group.levels, group.counters, strict=True))
            rows.append((*key, *first.merge(rest).row()))
            if len(rows) == 500:
                yield pd.DataFrame(rows, columns=[*keys, "n", "levels", "counters"], dtype=object)
                rows = []
        yield pd.DataFrame(rows, columns=[*keys, "n", "levels", "counters"], dtype=object)

    return _by_key(parts.select(*keys, "n", "levels", "counters"), keys).mapInPandas(join, schema)


def percentiles(sketched: DataFrame, keys: list[str], pcts: list[float], section: int = SECTION, protect: str = "high") -> DataFrame:
    """(keys, n, pct, pct_value) of each sketch, for percentages from 0 to 100."""
    shares = np.asarray(pcts, dtype=float) / 100
    schema = f"{_kinds(sketched, keys)}, n long, pct double, pct_value double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*key, n, p, v)
                for *key, n, levels, counters in batch.itertuples(index=False, name=None)
                for p, v in zip(pcts, Compactors(section, protect, n, levels, counters).percentiles(shares), strict=True)
            ]
            frame = pd.DataFrame(rows, columns=[*keys, "n", "pct", "pct_value"], dtype=object)
            yield frame.where(frame.notna(), None)

    return sketched.select(*keys, "n", "levels", "counters").mapInPandas(read, schema)


def _counts(asked: DataFrame, held: DataFrame, keys: list[str], id_: str, count) -> DataFrame:
    """Lay each group's questions beside what is held of it, count, and add the groups of an id."""
    rows = held.withColumns({id_: F.lit(None).cast("long"), "point": F.lit(None).cast("double")}).unionByName(asked.select(*keys, F.col(id_).cast("long").alias(id_), "point"), allowMissingColumns=True)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            ask = group[id_].notna().to_numpy()
            if ask.all() or not ask.any():
                continue
            n, below, upto = count(group.point[ask].to_numpy(dtype=float), group[~ask])
            yield pd.DataFrame({id_: group[id_][ask].astype("int64"), "n": float(n), "below": below.astype(float), "upto": upto.astype(float)})

    found = _by_key(rows, keys).mapInPandas(match, f"{id_} long, n double, below double, upto double")
    return found.groupBy(id_).agg(F.sum("n").alias("n"), F.sum("below").alias("below"), F.sum("upto").alias("upto"))


def sketched_counts(asked: DataFrame, sketched: DataFrame, keys: list[str], id_: str, section: int = SECTION, protect: str = "high", blocks: int = 1) -> DataFrame:
    """(id, n, below, upto): estimated counts of values below and at most ``point``.

    ``asked`` has one row for each id and group asked; the counts of an id's
    groups are added, which is the count in their merged sketch. The questions to
    a group are dealt into ``blocks``, and a copy of its sketch goes to each. An
    id without a non-empty group has no row.
    """

    def count(points: np.ndarray, b: pd.DataFrame) -> tuple:
        s = Compactors(section, protect, b.n.iloc[0], b.levels.iloc[0], b.counters.iloc[0])
        return s.n, *s.counts(points)

    asked = asked.withColumn("block", F.pmod(F.xxhash64(id_), F.lit(blocks)))
    dealt = sketched.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return _counts(asked, dealt.select(*keys, "block", "n", "levels", "counters"), [*keys, "block"], id_, count)


def exact_counts(asked: DataFrame, values: DataFrame, keys: list[str], id_: str, blocks: int = 1) -> DataFrame:
    """(id, n, below, upto) as :func:`sketched_counts`, counted in ``values`` (keys, value) themselves.

    Only groups asked about are read. Their values are dealt into ``blocks``,
    whose counts are added, so no group need fit into a task.
    """
    # questions of one group share a single row while the values are reduced to the groups asked about
    wanted = values.join(asked.select(*keys).distinct(), keys, "left_semi")
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks))).select(*keys, "block", "value")
    asks = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(*keys, "block", id_, "point")

    def count(points: np.ndarray, b: pd.DataFrame) -> tuple:
        v = np.sort(b.value.to_numpy(dtype=float))
        return len(v), np.searchsorted(v, points, "left"), np.searchsorted(v, points, "right")

    return _counts(asks, dealt, [*keys, "block"], id_, count)
