"""Filters, validation and projections over halo tables. Each keeps columns it does not know."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.runtime import finite


def hosts(df: DataFrame, pid: str = "pid", mass: str = "m200b", cv: str = "cv") -> DataFrame:
    """Halos without parent (pid -1), of positive mass and finite cv; a null pid is no host."""
    return df.where((F.col(pid) == -1) & (F.col(mass) > 0) & ~F.isnan(mass) & finite(F.col(cv)))


def positive_mass(df: DataFrame, mass: str = "m200b") -> DataFrame:
    """Rows of positive, finite mass."""
    return df.where(finite(F.col(mass)) & (F.col(mass) > 0))


def min_mass(df: DataFrame, least: float, mass: str = "m200b") -> DataFrame:
    return df.where((F.col(mass) >= least) & ~F.isnan(mass))


def mass_range(df: DataFrame, low: float | None = None, high: float | None = None, mass: str = "m200b") -> DataFrame:
    """Rows with low <= mass <= high; either end may be open. Raises if low is above high."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lowest mass is above the highest")
    if low is not None:
        df = df.where((F.col(mass) >= low) & ~F.isnan(mass))
    return df.where(F.col(mass) <= high) if high is not None else df


def finite_features(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Rows in which every feature is neither null, NaN nor infinite; without features all rows."""
    return df.where(reduce(operator.and_, [finite(F.col(c)) for c in features], F.lit(True)))


def radius_window(df: DataFrame, low: float, high: float, radius: str = "rg") -> DataFrame:
    """Rows with low < radius < high, strict at both ends."""
    return df.where((F.col(radius) > low) & (F.col(radius) < high))


def in_sub_box(low: tuple, high: tuple, closed: bool = False, axes: tuple[str, ...] = ("x", "y", "z")) -> Column:
    """True where low <= position < high along each axis, or <= high when closed; null positions are outside."""
    parts = [(F.col(a) >= lo) & ((F.col(a) <= hi) if closed else (F.col(a) < hi)) for a, lo, hi in zip(axes, low, high, strict=True)]
    return F.coalesce(reduce(operator.and_, parts), F.lit(False))


def min_particles(df: DataFrame, count: int, particle_mass: Column | float, mass: str = "m200b") -> DataFrame:
    """Rows heavier than ``count`` particles, strictly."""
    return df.where(finite(F.col(mass)) & (F.col(mass) > count * F.lit(particle_mass)))


def keep_above(df: DataFrame, value: str, probability: str, threshold: float) -> DataFrame:
    """Null the value where its probability is below the threshold or unknown; the rows stay."""
    return df.withColumn(value, F.when(F.col(probability) >= threshold, F.col(value)))


def shifted(df: DataFrame, origin: tuple[float, float, float], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Positions relative to a new origin."""
    return df.withColumns({a: F.col(a) - o for a, o in zip(axes, origin, strict=True)})


def wrapped(position: Column, side: Column | float) -> Column:
    """A position folded into the periodic range from 0 to side."""
    return position - F.lit(side) * F.floor(position / F.lit(side))


def with_log_mass(df: DataFrame, mass: str = "m200b", into: str = "log10_m200b") -> DataFrame:
    """Add the log10 of the mass unless the column is there already; null where the mass is not positive."""
    return df if into in df.columns else df.withColumn(into, F.log10(F.when(F.col(mass) > 0, F.col(mass))))


def concentration(outer: str, scale: str) -> Column:
    """Outer radius over scale radius, null for a scale of 0."""
    return F.try_divide(F.col(outer), F.col(scale))


def require(df: DataFrame, columns: Iterable[str], what: str = "table", not_empty: bool = False) -> DataFrame:
    """The same table; raises if a column is missing or, on request, if there is no row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    if not_empty and df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


Attacher = Callable[[DataFrame], DataFrame]


def attach(df: DataFrame, names: Iterable[str], known: dict[str, Attacher]) -> DataFrame:
    """Apply the named stages in order. Raises for an unknown or repeated name."""
    names = list(names)
    if len(set(names)) != len(names):
        raise ValueError("a feature is named twice")
    for name in names:
        if name not in known:
            raise ValueError(f"unknown feature {name}; known are {sorted(known)}")
        df = df.transform(known[name])
    return df
