"""Fourier transforms of periodic grids, tidal tensors and halo bias fields.

A transform of a cube is three passes along its axes. In each pass the grid is
a table of pencils, arrays of n cells along one axis, which numpy transforms in
Arrow batches; between passes the cells are regrouped along the next axis. No
task holds more than its pencils, however large the cube. A cube of up to
``CUBE`` cells along a side is transformed whole in one task, which then holds
its half spectrum once or twice (135 MB each at 256); only its cells that
are not at ``empty`` are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.cosmology import gaussian_window, wave_number
from skylattice.operators.grid import cells_of, cloud_in_cell, corner_shares, deposit, full_grid, in_cells, in_runs, overdensity, pencil_schema, pencils, placed, runs_of, trilinear
from skylattice.runtime import stage

AXES = ("i", "j", "k")
CUBE = 256
COMPONENTS = ("t00", "t01", "t02", "t11", "t12", "t22")
#: Scales for which a task makes the tensors of a whole cube, one after another.
SCALES_A_TASK = 5


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _pass(cells: DataFrame, axis: str, n: int, inverse: bool, keys: list[str], parts: tuple[str, ...]) -> DataFrame:
    """Transform all parts along one axis; absent cells are 0."""
    others = [*keys, *[a for a in AXES if a != axis]]
    columns = [f"{c}{part}" for part in parts for c in ("re", "im")]
    pencils = cells.groupBy(*others).agg(F.collect_list(F.struct(F.col(axis).alias("at"), *columns)).alias("p"))
    pencils = pencils.select(*others, *[F.col(f"p.{c}").alias(c) for c in ("at", *columns)])
    schema = ", ".join([*[f"{c} {_kind(cells, c)}" for c in others], *[f"{c} array<double>" for c in columns]])

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            row, at = np.repeat(np.arange(len(batch)), batch["at"].map(len)), np.concatenate(batch["at"].to_list())
            out = batch[others].copy()
            for part in parts:
                dense = np.zeros((len(batch), n), dtype=complex)
                dense[row, at] = np.concatenate(batch[f"re{part}"].to_list()) + 1j * np.concatenate(batch[f"im{part}"].to_list())
                moved = np.fft.ifft(dense, axis=1) if inverse else np.fft.fft(dense, axis=1)
                out[f"re{part}"], out[f"im{part}"] = list(moved.real), list(moved.imag)
            yield out

    done = pencils.mapInPandas(transform, schema)
    return done.select(*others, F.posexplode(F.arrays_zip(*columns)).alias(axis, "c")).select(*keys, *[F.col(a).cast("int").alias(a) for a in AXES], *[F.col(f"c.{c}").alias(c) for c in columns])


def fft3(cells: DataFrame, n: int, inverse: bool = False, keys: list[str] | None = None, parts: tuple[str, ...] = ("",)) -> DataFrame:
    """(keys, i, j, k, re, im): the transform of each cube of n^3 cells given as (keys, i, j, k, re, im).

    Several cubes of one key travel as ``parts``: columns re and im with the part's name behind.
    """
    for axis in ("k", "j", "i"):
        cells = _pass(cells, axis, n, inverse, keys or ["space"], parts)
    return cells


def spectrum(delta: DataFrame, n: int) -> DataFrame:
    """(space, i, j, k, re, im): the transform of a real grid (space, i, j, k, v); absent cells are 0."""
    return fft3(delta.select("space", *AXES, F.col("v").alias("re"), F.lit(0.0).alias("im")), n)


def _waves(n: int, side: Column) -> list[Column]:
    return [wave_number(F.col(a), F.lit(n), side) for a in AXES]


def tidal_tensors(delta: DataFrame, sides: DataFrame, n: int, scales: list[float | None], physical: bool = True, kind: str = "float", empty: float = 0.0, digits: int | None = None) -> DataFrame:
    """(space, scale, i, j, k, t00, t01, t02, t11, t12, t22): smoothed tidal tensors, stored as ``kind``.

    T_ab is the inverse transform of k_a k_b / k^2 W(kR) delta_k, 0 at k = 0; the
    trace is the smoothed overdensity. Absent cells are at ``empty``, ``digits``
    rounds. ``physical=False`` gives the slots of published tables, in which T11
    stands in the place of T02 and the other way round.

    A task transforms a cube and makes a few scales of it, a plane at a time.
    """
    if n > CUBE:
        wide = _tensors_by_pencils(full_grid(delta, n, empty) if empty else delta, sides, n, scales)
        wide = wide if digits is None else wide.withColumns({t: F.round(t, digits) + 0.0 for t in COMPONENTS})
    else:
        wide = _tensors_by_cubes(_cells(delta, sides, n, parts=_parts(scales)), n, scales, empty, digits)
    wide = wide.select("space", "scale", *AXES, *[F.col(t).cast(kind).alias(t) for t in COMPONENTS])
    return wide if physical else wide.withColumns({"t02": F.col("t11"), "t11": F.col("t02")})


def tidal_tensors_of_points(points: DataFrame, sides: DataFrame, n: int, scales: list[float | None], digits: int | None = None) -> DataFrame:
    """:func:`tidal_tensors`, as doubles, of the overdensity of points, deposited in the tasks that transform the cube, so that a point is shuffled and not its eight cells."""
    if n > CUBE:
        return tidal_tensors(overdensity(cloud_in_cell(points, n), n), sides, n, scales, kind="double", empty=-1.0, digits=digits)
    wide = _tensors_by_cubes(_points(points, sides, n, parts=_parts(scales)), n, scales, -1.0, digits)
    return wide.select("space", "scale", *AXES, *COMPONENTS)


def _tensors_by_pencils(delta: DataFrame, sides: DataFrame, n: int, scales: list[float | None]) -> DataFrame:
    """:func:`tidal_tensors` of a grid whose absent cells are 0; the forward transform is made once for all components and scales."""
    waves = stage(spectrum(delta, n).join(sides, "space"), "spectrum")
    rows = waves.select("space", *AXES, "re", "im", "side", F.explode(F.array(*[F.lit(float(s) if s is not None else 0.0) for s in scales])).alias("scale"))
    rows = rows.withColumns({f"k_{a}": w for a, w in zip(AXES, _waves(n, F.col("side")), strict=True)})
    k2 = F.col("k_i") ** 2 + F.col("k_j") ** 2 + F.col("k_k") ** 2
    rows = rows.withColumns({"k2": k2, "w": gaussian_window(k2, F.col("scale"))})
    # the six components of a cell stay in one row through all passes
    names = {"t00": "ii", "t01": "ij", "t02": "ik", "t11": "jj", "t12": "jk", "t22": "kk"}
    factor = {t: F.coalesce(F.try_divide(F.col(f"k_{a}") * F.col(f"k_{b}"), "k2"), F.lit(0.0)) * F.col("w") for t, (a, b) in names.items()}
    scaled = rows.select("space", "scale", *AXES, *[(F.col(c) * f).alias(f"{c}{t}") for t, f in factor.items() for c in ("re", "im")])
    back = fft3(scaled, n, inverse=True, keys=["space", "scale"], parts=tuple(names))
    return back.select("space", "scale", *AXES, *[F.col(f"re{t}").alias(t) for t in names])


def _parts(scales: list[float | None]) -> int:
    return max(1, math.ceil(len(scales) / SCALES_A_TASK))


def _tensors_by_cubes(cells: DataFrame, n: int, scales: list[float | None], empty: float, digits: int | None) -> DataFrame:
    """:func:`tidal_tensors` of cubes that a task can hold, from the rows of :func:`_cells` or :func:`_points`."""
    parts, scales = _parts(scales), [float(s) if s is not None else 0.0 for s in scales]
    ends, j = pa.array(np.arange(0, n * n + 1, n, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for space, part, side, spec, _ in _cubes(batches, n, empty):
            k = _numbers(n, side)
            for i in range(n):
                k2 = k[i] ** 2 + k[:, None] ** 2 + k[: n // 2 + 1] ** 2
                k2[k2 == 0] = 1.0
                spec[i] /= k2
            for scale in scales[part::parts]:
                for i, planes in _tensor_planes(n, side, scale, spec):
                    values = [pa.ListArray.from_arrays(ends, pa.array(plane.reshape(-1))) for plane in _rounded(planes, digits)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(space, n), pa.repeat(pa.scalar(scale), n), pa.repeat(pa.scalar(i, pa.int32()), n), j, *values], names=["space", "scale", "i", "j", *COMPONENTS])
            del spec

    schema = f"space {_kind(cells, 'space')}, scale double, i int, j int, " + ", ".join(f"{t} array<double>" for t in COMPONENTS)
    rows = cells.mapInArrow(transform, schema)
    # an element of each array by its index: arrays_zip would make an object of every cell
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    return rows.select("space", "scale", *AXES, *[F.get(t, F.col("k")).alias(t) for t in COMPONENTS])


def _tensor_planes(n: int, side: float, scale: float, spec: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the six components) of each plane of the smoothed tidal tensors; ``spec`` is a half spectrum over k^2.

    The factors k_a k_b and the window are products over axes. So three cubes,
    the waves times 1, k_i and k_i^2 transformed back along i, hold all six
    components. Of these cubes every fourth plane is made at a time: waves a
    quarter of the axis apart are alike there, but for a turn, and are added first.
    """
    k, m, half = _numbers(n, side), n // 2 + 1, n // 2
    w, odd, nyquist = np.exp(-0.5 * (k * max(scale, 0.0)) ** 2), k.copy(), 0.0
    if n % 2 == 0:  # a product of two axes has no real part where one of them alone is at its Nyquist index
        odd[half], nyquist = 0.0, k[half]
    both = w[:, None] * w[:m]
    along = np.stack([both, odd[:, None] * both, odd[:m] * both, k[:, None] ** 2 * both, odd[:, None] * odd[:m] * both, k[:m] ** 2 * both])
    lone = spec[half] * both * (nyquist**2 * w[half] / n)  # the waves at the Nyquist index of i and another axis
    if n % 2 == 0:
        along[4, half, half] = nyquist**2 * both[half, half]
    step = math.gcd(n, 4)
    for first in range(step):
        turn = w * np.exp(2j * np.pi * first * np.arange(n) / n) / step
        cubes = np.empty((3, n // step, n, m), dtype=complex)
        for cube, factor in zip(cubes, (turn, turn * odd, turn * k**2), strict=True):
            for j in range(0, n, 8):
                some = spec[:, j : j + 8] * factor[:, None, None]
                cube[:, j : j + 8] = np.fft.ifft(some.reshape(step, n // step, *some.shape[1:]).sum(axis=0), axis=0)
        for at in range(n // step):
            i = first + at * step
            waves = cubes[[2, 1, 1, 0, 0, 0], at] * along
            if n % 2 == 0:
                waves[1, half] += (-1) ** i * lone[half]
                waves[2, :, half] += (-1) ** i * lone[:, half]
            yield i, np.fft.irfft(np.fft.ifft(waves, axis=1), n)


def _cells(delta: DataFrame, sides: DataFrame, n: int, wanted: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """(space, part, side, at, v) in runs of a space and part: the cells of the grids, and the cells wanted with a null v. Every part has all cells."""
    at = ((F.col("i") * n + F.col("j")) * n + F.col("k")).cast("int").alias("at")
    rows = delta.where("v IS NOT NULL").select("space", at, F.col("v").cast("double").alias("v"))
    if wanted is not None:
        rows = rows.unionByName(wanted.select("space", at, F.lit(None).cast("double").alias("v")))
    return _runs_of_cubes(rows, sides, n, parts)


def _points(points: DataFrame, sides: DataFrame, n: int, parts: int = 1) -> DataFrame:
    """(space, part, side, x, y, z) in runs of a space and part: the points, in units of a cell. Every part has all points."""
    return _runs_of_cubes(in_cells(points, n), sides, n, parts)


def _runs_of_cubes(rows: DataFrame, sides: DataFrame, n: int, parts: int) -> DataFrame:
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    keys = ["space", "part"] if parts > 1 else ["space"]
    return in_runs(rows.join(sides, "space").select("space", part.alias("part"), F.col("side").cast("double").alias("side"), *rows.columns[1:]), n, keys, keys, n)


def _cubes(batches: Iterator[pa.RecordBatch], n: int, empty: float, k_max: float | None = None) -> Iterator[tuple[pa.Scalar, int, float, np.ndarray, np.ndarray]]:
    """(space, part, side, half spectrum, cells wanted) of each cube; with ``k_max`` of its last axis only the indices up to that wave number.

    Of points the cube is their overdensity.
    """
    space, part, side, cube, wanted, of_points = None, 0, 0.0, None, [], False

    def spectrum_of() -> np.ndarray:
        if of_points:
            np.divide(cube, cube.sum() / n**3, out=cube)
            np.subtract(cube, 1.0, out=cube)
        m = n // 2 + 1 if k_max is None else min(n // 2, int(k_max * side / (2 * np.pi)) + 1) + 1
        out = np.empty((n, n, m), dtype=complex)
        for i in range(n):
            out[i] = np.fft.fft(np.fft.rfft(cube[i * n * n : (i + 1) * n * n].reshape(n, n))[:, :m], axis=0)
        _along_i(out, np.fft.fft)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        names, of, sides, of_points = batch["space"].to_numpy(zero_copy_only=False), batch["part"].to_numpy(), batch["side"].to_numpy(), "x" in batch.schema.names
        if of_points:
            places = [batch[a].to_numpy() for a in "xyz"]
        else:
            at, v = batch["at"].to_numpy(), batch["v"].to_numpy(zero_copy_only=False)
            given = batch["v"].is_valid().to_numpy(zero_copy_only=False)  # NaN is a value
        for lo, hi in runs_of(names, of):
            if cube is None or batch["space"][lo] != space or of[lo] != part:
                if cube is not None:
                    spec = spectrum_of()
                    cube = None
                    yield space, part, side, spec, np.concatenate(wanted or [[]])
                    spec = None
                space, part, side, cube, wanted = batch["space"][lo], int(of[lo]), float(sides[lo]), np.full(n**3, 0.0 if of_points else float(empty)), []
            if of_points:
                deposit(cube, n, *[c[lo:hi] for c in places])
                continue
            has = given[lo:hi]
            cube[at[lo:hi][has]] = v[lo:hi][has]
            wanted.append(at[lo:hi][~has])
    if cube is not None:
        spec = spectrum_of()
        cube = None
        yield space, part, side, spec, np.concatenate(wanted or [[]])


def _along_i(spec: np.ndarray, transform) -> None:
    """Transform along the first axis in place, a few j at a time."""
    for j in range(0, spec.shape[1], 8):
        spec[:, j : j + 8] = transform(spec[:, j : j + 8], axis=0)


def _numbers(n: int, side: float) -> np.ndarray:
    """Wave numbers of the indices, the Nyquist index of an even n as negative."""
    return 2 * np.pi * np.fft.fftfreq(n, side / n)


def _rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """``v`` to so many digits, without -0; values too large to have more stay."""
    return v if digits is None else np.where(np.abs(v) < 2**52 / 10**digits, np.rint(v * 10**digits) / 10**digits, v) + 0.0


def smoothed(delta: DataFrame, sides: DataFrame, n: int, scale: float | None, empty: float = 0.0, digits: int | None = None) -> DataFrame:
    """(space, i, j, k, v): the grid smoothed with a Gaussian window; absent cells are at ``empty``, ``digits`` rounds."""
    if n > CUBE:
        back = _smoothed_by_pencils(full_grid(delta, n, empty), sides, n, scale)
        return back if digits is None else back.withColumn("v", F.round("v", digits) + 0.0)
    return _smoothed_cubes(_cells(delta, sides, n), n, scale, empty, digits)


def smoothed_points(points: DataFrame, sides: DataFrame, n: int, scale: float | None, digits: int | None = None) -> DataFrame:
    """:func:`smoothed` of the overdensity of points, deposited in the task that transforms the cube, so that a point is shuffled and not its eight cells."""
    if n > CUBE:
        return smoothed(overdensity(cloud_in_cell(points, n), n), sides, n, scale, -1.0, digits)
    return _smoothed_cubes(_points(points, sides, n), n, scale, -1.0, digits)


def _smoothed_cubes(rows: DataFrame, n: int, scale: float | None, empty: float, digits: int | None) -> DataFrame:
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for space, _, side, spec, _ in _cubes(batches, n, empty):
            w = np.exp(-0.5 * (_numbers(n, side) * max(scale or 0.0, 0.0)) ** 2)
            spec *= w[:, None, None]
            spec *= w[:, None] * w[: n // 2 + 1]
            _along_i(spec, np.fft.ifft)
            for i in range(n):
                yield pencils(space, i, _rounded(np.fft.irfft(np.fft.ifft(spec[i], axis=0), n), digits))
            del spec

    return cells_of(rows.mapInArrow(transform, pencil_schema(rows)))


def _kernels(n: int, side: float, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smoothed tidal tensors t00 and t01 around one cell at 1, at offsets of 0 to n // 2 cells along each axis.

    The others follow by exchanging axes. t00 is even along all axes, t01 odd
    along the first two, but for a part, given last by its offset along the third,
    that changes sign from cell to cell along the first two.
    """
    m = np.arange(n // 2 + 1)
    k = 2 * np.pi * m / side
    twice = np.where((m == 0) | (2 * m == n), 1.0, 2.0)
    cos, sin = (f(2 * np.pi * np.outer(m, m) / n) * twice for f in (np.cos, np.sin))
    k2 = k[:, None, None] ** 2 + k[:, None] ** 2 + k**2
    k2[0, 0, 0] = 1.0
    w = np.exp(-0.5 * (k * max(scale, 0.0)) ** 2)
    base = w[:, None, None] * (w[:, None] * w) / k2 / n**3

    def along(f: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        f = (a @ f.reshape(len(m), -1)).reshape(f.shape)
        return np.matmul(b, f) @ c.T

    t00, t01 = along(base * (k**2)[:, None, None], cos, cos, cos), -along(base * np.outer(k, k)[:, :, None], sin, sin, cos)
    # the waves at the Nyquist index along the first two axes are even
    return t00, t01, cos @ (base[-1, -1] * k[-1] ** 2) if n % 2 == 0 else np.zeros(len(m))


def _factors(n: int, side: float, scale: float, spec: np.ndarray) -> Iterator[np.ndarray]:
    """The half spectra of the six components, one at a time."""
    k = _numbers(n, side)
    w, odd = np.exp(-0.5 * (k * max(scale, 0.0)) ** 2), k.copy()
    nyquist = np.zeros(n)
    if n % 2 == 0:  # a product of two axes has no real part where one of them alone is at its Nyquist index
        odd[n // 2], nyquist[n // 2] = 0.0, k[n // 2]
    m = spec.shape[2]
    shaped = lambda x: (x[:, None, None], x[:, None], x[:m])
    for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
        out = np.empty_like(spec)
        for i in range(n):
            k2 = k[i] ** 2 + k[:, None] ** 2 + k[:m] ** 2
            k2[k2 == 0] = 1.0
            at = lambda x, axis: x[i] if axis == 0 else shaped(x)[axis]  # noqa: B023, E731
            f = at(k, a) ** 2 if a == b else at(odd, a) * at(odd, b) + at(nyquist, a) * at(nyquist, b)
            out[i] = spec[i] * (f * (w[i] * w[:, None] * w[:m] / k2))
        yield out


def _from_pairs(n: int, kernels: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, v: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The six components in the cells wanted: the kernels of all cells ``at``, times ``v``."""
    t00, t01, even = (x.reshape(-1) for x in kernels)
    m, out = n // 2 + 1, np.empty((6, len(wanted)))
    step = max(1, 500_000 // max(1, len(at)))
    for lo in range(0, len(wanted), step):
        some, d, sign = wanted[lo : lo + step], [], []
        for p in (2, 1, 0):
            x = (some // n**p % n)[:, None] - at // n**p % n
            far = np.abs(x)
            sign.append(np.where((x > 0) == (2 * far <= n), 1.0, -1.0))
            d.append(np.minimum(far, n - far))
        for c, (a, b, rest) in enumerate(((0, 1, 2), (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1))):
            where = (d[a] * m + d[b]) * m + d[rest]
            out[c, lo : lo + step] = (t00[where] if c in (0, 3, 5) else t01[where] * sign[a] * sign[b] + (1 - 2 * ((d[a] + d[b]) % 2)) * even[d[rest]]) @ v
    return out


def _half_spectrum(n: int, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The transform of a cube that is 0 but for the cells ``at``."""
    cube = np.zeros(n**3)
    cube[at] = v
    spec = np.fft.rfft(cube.reshape(n, n, n))
    del cube
    for i in range(n):
        spec[i] = np.fft.fft(spec[i], axis=0)
    _along_i(spec, np.fft.fft)
    return spec


def _from_spectrum(n: int, side: float, scale: float, spec: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The six components in the cells wanted: the transform back, whose last axis is made for their pencils alone."""
    i, j, k = (wanted // n**p % n for p in (2, 1, 0))
    out = np.empty((6, len(wanted)))
    for c, part in enumerate(_factors(n, side, scale, spec)):
        _along_i(part, np.fft.ifft)
        for plane in np.unique(i):
            mine = np.flatnonzero(i == plane)
            out[c, mine] = np.fft.irfft(np.fft.ifft(part[plane], axis=0)[j[mine]], n)[np.arange(len(mine)), k[mine]]
    return out


def tidal_tensors_at(wanted: DataFrame, delta: DataFrame, sides: DataFrame, n: int, scales: list[float], empty: float = 0.0, kind: str = "float") -> DataFrame:
    """:func:`tidal_tensors` in the cells (space, scale, i, j, k) of ``wanted``; absent cells of ``delta`` are at ``empty``.

    A task holds a few spaces of one side. Where cells given and cells wanted are
    few the kernel of a scale is summed over their pairs; where they are many,
    the cube is transformed for each scale.
    """
    if n > CUBE:
        return tidal_tensors(full_grid(delta, n, empty), sides, n, scales, kind=kind).join(wanted.distinct(), ["space", "scale", *AXES], "left_semi")
    cell = ((F.col("i") * n + F.col("j")) * n + F.col("k")).cast("int").alias("at")
    # a constant has no tide, so the cells count by what they have above the absent ones
    rows = delta.where("v IS NOT NULL").select("space", F.lit(None).cast("double").alias("scale"), cell, (F.col("v") - empty).cast("double").alias("v"))
    rows = rows.unionByName(wanted.select("space", F.col("scale").cast("double").alias("scale"), cell, F.lit(None).cast("double").alias("v")).distinct())
    rows = rows.join(sides, "space").select("space", F.col("side").cast("double").alias("side"), "scale", "at", "v", F.pmod(F.xxhash64("space"), F.lit(16)).alias("part"))

    def solved(held: list[tuple], side: float) -> Iterator[pa.RecordBatch]:
        """The tensors of the spaces held: (space, cells, values, scales of the cells wanted, cells wanted)."""
        by_pairs = [len(wanted) * len(at) < len(np.unique(scale)) * n**3 for _, at, _, scale, wanted in held]
        out: list[list] = [[] for _ in held]
        for s in np.unique(np.concatenate([x[3] for x in held])):
            kernels = None
            for x, (_, at, v, scale, cells) in enumerate(held):
                if by_pairs[x] and (scale == s).any():
                    kernels = kernels or _kernels(n, side, float(s))
                    out[x].append((s, cells[scale == s], _from_pairs(n, kernels, at, v, cells[scale == s])))
        for x, (space, at, v, scale, cells) in enumerate(held):
            if not by_pairs[x]:
                spec = _half_spectrum(n, at, v)
                out[x] = [(s, cells[scale == s], _from_spectrum(n, side, float(s), spec, cells[scale == s])) for s in np.unique(scale)]
                del spec
            for s, cells_, t in out[x]:
                index = [pa.array((cells_ // n**p % n).astype(np.int32)) for p in (2, 1, 0)]
                yield pa.RecordBatch.from_arrays([pa.repeat(space, len(cells_)), pa.repeat(pa.scalar(float(s)), len(cells_)), *index, *map(pa.array, t)], names=["space", "scale", *AXES, *COMPONENTS])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_, at_side, space = [], [], None, None

        def close() -> None:
            if open_:
                at, v, scale = (np.concatenate(c) for c in zip(*open_, strict=True))
                given = v == v
                held.append((space, at[given], v[given], scale[~given], at[~given]))
                open_.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names, side = batch["space"].to_numpy(zero_copy_only=False), batch["side"].to_numpy()
            at, v, scale = batch["at"].to_numpy().astype(np.int64), batch["v"].to_numpy(zero_copy_only=False), batch["scale"].to_numpy(zero_copy_only=False)
            for lo, hi in runs_of(side, names):
                if batch["space"][lo] != space:
                    close()
                    if held and (side[lo] != at_side or sum(len(x[1]) + len(x[4]) for x in held) > 300_000):
                        yield from solved(held, at_side)
                        held = []
                    space, at_side = batch["space"][lo], float(side[lo])
                open_.append((at[lo:hi], v[lo:hi], scale[lo:hi]))
        close()
        if held:
            yield from solved(held, at_side)

    schema = f"space {_kind(delta, 'space')}, scale double, i int, j int, k int, " + ", ".join(f"{c} double" for c in COMPONENTS)
    dealt = in_runs(rows, n, ["side", "part"], ["side", "space"], n).select("space", "side", "scale", "at", "v")
    return dealt.mapInArrow(transform, schema).select("space", "scale", *AXES, *[F.col(c).cast(kind).alias(c) for c in COMPONENTS])


def _smoothed_by_pencils(delta: DataFrame, sides: DataFrame, n: int, scale: float | None) -> DataFrame:
    """(space, i, j, k, v): the grid smoothed with a Gaussian window."""
    waves = spectrum(delta, n).join(sides, "space")
    k = _waves(n, F.col("side"))
    w = gaussian_window(k[0] ** 2 + k[1] ** 2 + k[2] ** 2, scale)
    back = fft3(waves.select("space", *AXES, (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im")), n, inverse=True)
    return back.select("space", *AXES, F.col("re").alias("v"))


def bias_field(delta: DataFrame, sides: DataFrame, n: int, k_max: float) -> DataFrame:
    """(space, i, j, k, v): the field whose value at a halo is its linear bias.

    The inverse transform of delta_k / P over waves with 0 < k <= k_max, with
    delta_k over n^3, P = |delta_k|^2 V floored at 1e-30, times n^3.
    """
    waves = spectrum(delta, n).join(sides, "space").withColumns({"re": F.col("re") / n**3, "im": F.col("im") / n**3})
    k = _waves(n, F.col("side"))
    size = F.sqrt(k[0] ** 2 + k[1] ** 2 + k[2] ** 2)
    power = F.greatest((F.col("re") ** 2 + F.col("im") ** 2) * F.pow("side", F.lit(3)), F.lit(1e-30))
    kept = F.when((size > 0) & (size <= k_max), 1 / power).otherwise(F.lit(0.0))
    back = fft3(waves.select("space", *AXES, (F.col("re") * kept).alias("re"), (F.col("im") * kept).alias("im")), n, inverse=True)
    return back.select("space", *AXES, (F.col("re") * n**3).alias("v"))


def halo_bias(halos: DataFrame, delta: DataFrame, sides: DataFrame, n: int, k_max: float, empty: float = 0.0) -> DataFrame:
    """(id, v): the bias of each halo, read trilinearly off :func:`bias_field`; absent cells of ``delta`` are at ``empty``.

    Of a cube made in one task, only the cells around halos leave it.
    """
    if n > CUBE:
        return trilinear(halos, bias_field(full_grid(delta, n, empty), sides, n, k_max), n)
    near = corner_shares(placed(halos).select(F.col("box").alias("space"), "x", "y", "z", "side"), n).select("space", *AXES).distinct()

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for space, _, side, spec, wanted in _cubes(batches, n, empty, k_max):
            k = _numbers(n, side)
            size = np.sqrt(k[:, None, None] ** 2 + k[:, None] ** 2 + k[: spec.shape[2]] ** 2)
            spec /= n**3
            power = np.maximum((spec.real**2 + spec.imag**2) * side**3, 1e-30)
            spec *= np.where((size > 0) & (size <= k_max), 1 / power, 0.0)
            del size, power
            _along_i(spec, np.fft.ifft)
            wanted = np.sort(wanted)
            planes = wanted // n**2
            for lo, hi in runs_of(planes):
                if hi == lo:
                    continue
                plane = np.fft.irfft(np.fft.ifft(spec[planes[lo]], axis=0), n).reshape(-1) * n**3
                at = wanted[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.repeat(space, hi - lo), *[pa.array((at // n**p % n).astype(np.int32)) for p in (2, 1, 0)], pa.array(plane[at % n**2])], names=["space", *AXES, "v"])
            del spec

    field = _cells(delta, sides, n, near).mapInArrow(transform, f"space {_kind(delta, 'space')}, i int, j int, k int, v double")
    return trilinear(halos, field, n)
