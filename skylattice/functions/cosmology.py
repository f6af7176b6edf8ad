"""Column expressions of cosmology, scales and bins. Null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: critical density in h^2 Msun / Mpc^3 and the mean-density contrast of the 200b definition
CRITICAL_DENSITY = 2.775e11
CONTRAST = 200.0


def mean_density(omega_m, h, z=0.0) -> Column:
    """Mean matter density at redshift z."""
    return F.lit(omega_m) * CRITICAL_DENSITY * F.lit(h) ** 2 * (1 + F.lit(z)) ** 3


def r200b(mass: Column, omega_m, h, z=0.0) -> Column:
    """Radius that encloses 200 times the mean density; null for a negative mass."""
    return F.when(mass >= 0, F.pow(3 * mass / (4 * math.pi * CONTRAST * mean_density(omega_m, h, z)), F.lit(1 / 3)))


def m200b(radius: Column, omega_m, h, z=0.0, legacy: bool = False) -> Column:
    """Mass within a 200b radius; ``legacy`` leaves the contrast out, as published numbers did."""
    return 4 / 3 * math.pi * (1.0 if legacy else CONTRAST) * mean_density(omega_m, h, z) * radius**3


def gaussian_radius(r: Column) -> Column:
    """The Gaussian smoothing radius of a halo of radius r: four radii as a top hat, as a Gaussian."""
    return 4 * r / math.sqrt(5)


def linked_mass(length: Column, particle_mass: Column) -> Column:
    """Mass of a group of ``length`` linked particles."""
    return length * particle_mass


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null or NaN."""
    return F.when(~F.isnan(a) & ~F.isnan(b), F.try_divide(a, b))


def linear_in_scale(value0: Column, value1: Column, scale0: Column, scale1: Column, at: Column) -> Column:
    """The value at a scale between two tabulated ones; the lower value where they coincide."""
    return F.coalesce(value0 + (value1 - value0) * F.try_divide(at - scale0, scale1 - scale0), value0)


def wave_number(index: Column, n, side) -> Column:
    """Wave number of a Fourier index 0..n-1; the Nyquist index of an even n counts as negative."""
    return 2 * math.pi / F.lit(side) * F.when(index < F.floor((F.lit(n) + 1) / 2), index).otherwise(index - F.lit(n))


def gaussian_window(k2: Column, radius: Column | float | None) -> Column:
    """exp(-k^2 R^2 / 2), elementwise; no radius or one that is not positive smooths nothing."""
    if isinstance(radius, Column):
        return F.exp(-0.5 * k2 * F.pow(F.greatest(radius, F.lit(0.0)), F.lit(2)))
    return F.lit(1.0) if radius is None or radius <= 0 else F.exp(-0.5 * k2 * radius * radius)


def log_grid(low: float, high: float, n: int) -> list[float]:
    """n points from low to high at equal ratios."""
    step = (math.log10(high) - math.log10(low)) / (n - 1) if n > 1 else 0.0
    return [10 ** (math.log10(low) + step * k) for k in range(n)]


def linear_grid(low: float, high: float, n: int) -> list[float]:
    """n points from low to high at equal steps."""
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]


def smoothing_scales(side: float = 1000.0, cells: int = 4096, top: float = 4.0, n: int = 20) -> list[float]:
    """The tabulated smoothing radii: log spaced from the cell size up, without the first."""
    return log_grid(side / cells, top, n)[1:]


def mass_bin_edges(top: float, bottom: float = 11.5, n: int = 10) -> list[float]:
    """Edges of equal bins in log10 mass up to ``top``."""
    return linear_grid(bottom, top, n)


def midpoints(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]


def bin_of(value: Column, edges: list[float], closed: bool = False) -> Column:
    """0-based bin [lo, hi) of a value, null outside and for null or NaN; ``closed`` adds the top edge to the last bin."""
    last = len(edges) - 2
    found = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    top = value <= edges[-1] if closed else value < edges[-1]
    return F.when((value >= edges[0]) & top & ~F.isnan(value), F.least(found, F.lit(last)))
