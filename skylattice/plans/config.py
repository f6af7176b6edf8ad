"""Run settings as plain dataclasses; unknown keys are ignored, missing ones keep their defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from skylattice.functions.cosmology import linear_grid
from skylattice.operators.calibration import Calibration


@dataclass(frozen=True)
class Grid:
    n: int = 8
    scales: tuple[float, ...] = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0)
    physical: bool = True


@dataclass(frozen=True)
class MassFilter:
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError("the lowest mass is above the highest")


@dataclass(frozen=True)
class Bias:
    enabled: bool = True
    only: bool = False
    k_max: float = 0.2
    share: float = 0.25

    def __post_init__(self):
        if self.only and not self.enabled:
            raise ValueError("assembly_bias.only requires assembly_bias.enabled")


@dataclass(frozen=True)
class Settings:
    """Settings of a whole run; ``bottom`` and ``top`` bound the log10 mass bins, top None is the heaviest training halo."""

    features: tuple[str, ...] = ("log10_m200b", "env")
    properties: tuple[str, ...] = ("cv", "spin", "ca", "ba")
    tidal: bool = False
    preprocess: bool = True
    enrichment: bool = True
    hold_out: bool = False
    n_bins: int = 6
    bottom: float = 9.0
    top: float | None = None
    min_rows: int = 50
    seed: int = 0
    grid: Grid = field(default_factory=Grid)
    mass_filter: MassFilter = field(default_factory=MassFilter)
    calibration: Calibration = field(default_factory=Calibration)
    assembly_bias: Bias = field(default_factory=Bias)

    def edges(self, heaviest: float | None) -> list[float]:
        top = self.top if self.top is not None else heaviest
        if top is None or top <= self.bottom:
            raise ValueError("no mass above the lowest bin edge")
        return linear_grid(self.bottom, top, self.n_bins + 1)


def from_dict(kind: type, values: dict[str, Any]):
    """A dataclass from nested plain values."""
    defaults = kind()
    out = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        value, default = values[f.name], getattr(defaults, f.name)
        out[f.name] = from_dict(type(default), value) if is_dataclass(default) and isinstance(value, dict) else tuple(value) if isinstance(default, tuple) else value
    return kind(**out)


def load(path: str) -> Settings:
    with open(path) as f:
        return from_dict(Settings, json.load(f))
