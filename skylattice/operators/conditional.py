"""A conditional multivariate Gaussian per mass bin: properties given features.

Every column is mapped to normal scores by its own quantiles, in which the joint
distribution of a bin is one mean vector and one covariance matrix. Given the
features, the properties are normal with a known mean and spread; a draw is
mapped back by the quantiles of the properties. All that is fitted are
aggregates, so no bin is gathered: quantiles first, then medians and
covariances of the scores. The fitted table has one row for each bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import normal
from skylattice.functions.cosmology import bin_of
from skylattice.runtime import finite

N_QUANTILES = 500
# fixed values: weighted sums of properties that draws must not bring below a bound: none negative, ca <= ba <= 1
CONSTRAINTS = (({"cv": 1}, 0), ({"spin": 1}, 0), ({"ca": 1}, 0), ({"ba": 1, "ca": -1}, 0), ({"ba": -1}, -1))


@dataclass
class BinModel:
    """What is fitted for one bin: quantiles of every column, means and covariance of their scores."""

    n: int
    quantiles: dict[str, list[float]]
    mean: list[float]
    cov: list[list[float]]


def with_bin(df: DataFrame, edges: list[float], mass: str = "m200b") -> DataFrame:
    """Add ``bin`` of log10 mass, [lo, hi), null outside."""
    return df.withColumn("bin", bin_of(F.log10(F.when(F.col(mass) > 0, F.col(mass))), edges))


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = df.where("bin IS NOT NULL")
    for c in columns:
        rows = rows.where(finite(F.col(c)))
    return rows


def _score(values: np.ndarray, quantiles: np.ndarray) -> np.ndarray:
    """Normal scores; ties get the middle of their range."""
    at = np.linspace(0, 1, len(quantiles))
    up = np.interp(values, quantiles, at)
    down = 1 - np.interp(-values, -quantiles[::-1], at)
    return np.clip(normal.ppf(np.clip((up + down) / 2, 1e-7, 1 - 1e-7)), -normal.bound(), normal.bound())


def _quantiles(rows: DataFrame, columns: list[str], n: int, exact: bool) -> dict[int, dict]:
    probabilities = [k / (n - 1) for k in range(n)]
    q = (lambda c: F.percentile(c, F.array(*[F.lit(p) for p in probabilities]))) if exact else (lambda c: F.percentile_approx(c, probabilities, 100_000))
    return {r["bin"]: r.asDict() for r in rows.groupBy("bin").agg(F.count("*").alias("n"), *[q(c).alias(c) for c in columns]).collect()}


def _scored(rows: DataFrame, columns: list[str], quantiles: dict[int, dict], keep: list[str]) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    tables = {b: {c: np.asarray(q[c], dtype=float) for c in columns} for b, q in quantiles.items()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].assign(**{c: np.nan for c in columns})
            for b, at in batch.groupby("bin").indices.items():
                for c in columns:
                    out.iloc[at, out.columns.get_loc(c)] = _score(batch[c].to_numpy()[at], tables[b][c])
            yield out

    return rows.select(*keep, *columns).mapInPandas(score, f"{kinds}, " + ", ".join(f"{c} double" for c in columns))


def fit(df: DataFrame, features: list[str], properties: list[str], min_rows: int = 50, n_quantiles: int = N_QUANTILES, exact: bool = False) -> dict[int, BinModel]:
    """The model of every bin with at least ``min_rows`` complete rows; ``df`` has ``bin``.

    Two passes of aggregates; what comes to the driver is a few figures for each
    bin. ``exact`` takes exact quantiles, which hold the distinct values of a bin.
    """
    columns = features + properties
    rows = _complete(df, columns)
    sizes = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    keep = [b for b, n in sizes.items() if n >= max(min_rows, 2)]
    if not keep:
        return {}
    rows = rows.where(F.col("bin").isin(keep))
    quantiles = _quantiles(rows, columns, n_quantiles, exact)
    scored = _scored(rows, columns, quantiles, ["bin"])
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    middle = (lambda c: F.percentile(c, 0.5)) if exact else (lambda c: F.percentile_approx(c, 0.5, 100_000))
    found = scored.groupBy("bin").agg(*[middle(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    models = {}
    for r in found.collect():
        cov = [[r[f"c_{a}_{b}"] if (a, b) in pairs else r[f"c_{b}_{a}"] for b in columns] for a in columns]
        models[r["bin"]] = BinModel(sizes[r["bin"]], {c: list(quantiles[r["bin"]][c]) for c in columns}, [r[f"m_{c}"] for c in columns], cov)
    return models


def predict(df: DataFrame, models: dict[int, BinModel], features: list[str], properties: list[str], id_: str, seed: int = 0, refit: bool = True, constraints=CONSTRAINTS, redraws: int = 20) -> DataFrame:
    """(id, bin, properties, constraint_ok): a draw for every row of a fitted bin.

    ``refit`` maps the features by the quantiles of ``df`` itself, as its values
    may be distributed otherwise. Draws that break a constraint are repeated up
    to ``redraws`` times; what still breaks one is kept and marked;
    constraints on properties that are not drawn do not apply. A draw
    depends on the id and the seed only, not on partitions. Rows without a model
    or with an unknown feature have no row here.
    """
    rows = _complete(df, features).where(F.col("bin").isin(list(models) or [-1]))
    kind = df.schema[id_].dataType.simpleString()
    schema = f"{id_} {kind}, bin int, " + ", ".join(f"{p} double" for p in properties) + ", constraint_ok boolean"
    own = _quantiles(rows, features, N_QUANTILES, False) if refit and models else {}
    nx = len(features)
    limits = [(np.array([float(w.get(p, 0)) for p in properties]), float(b)) for w, b in constraints or () if set(w) <= set(properties)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for b, at in batch.groupby("bin").indices.items():
                model, group = models[b], batch.iloc[at]
                table = own.get(b) or model.quantiles
                x = np.stack([_score(group[c].to_numpy(dtype=float), np.asarray(table[c], dtype=float)) for c in features], axis=1)
                mean, cov = np.asarray(model.mean), np.asarray(model.cov)
                gain = cov[nx:, :nx] @ np.linalg.pinv(cov[:nx, :nx])
                rest = cov[nx:, nx:] - gain @ cov[:nx, nx:]
                values, vectors = np.linalg.eigh((rest + rest.T) / 2)
                root = vectors * np.sqrt(np.maximum(values, 0))
                center = mean[nx:] + (x - mean[:nx]) @ gain.T
                noise = np.stack([np.random.default_rng((seed, int(i) & 0x7FFFFFFFFFFFFFFF)).standard_normal((redraws + 1, len(properties))) for i in group[id_]])
                out, ok = np.full(center.shape, np.nan), np.zeros(len(group), dtype=bool)
                for t in range(redraws + 1):
                    todo = ~ok
                    if not todo.any():
                        break
                    z = center[todo] + noise[todo, t] @ root.T
                    y = np.stack([np.interp(normal.cdf(z[:, k]), np.linspace(0, 1, len(model.quantiles[p])), model.quantiles[p]) for k, p in enumerate(properties)], axis=1)
                    out[todo] = y
                    ok[todo] = np.all([y @ a >= c - 1e-12 for a, c in limits], axis=0) if limits else True
                parts.append(pd.DataFrame({id_: group[id_].to_numpy(), "bin": b} | {p: out[:, k] for k, p in enumerate(properties)} | {"constraint_ok": ok}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return rows.select(id_, "bin", *features).mapInPandas(draw, schema)


def enrich(target: DataFrame, training: DataFrame, edges: list[float], features: list[str], properties: list[str], id_: str, mass: str = "m200b", min_rows: int = 50, seed: int = 0) -> DataFrame:
    """``target`` with predicted properties, null where its bin has no model."""
    models = fit(with_bin(training, edges), features, properties, min_rows)
    rows = with_bin(target, edges, mass)
    drawn = predict(rows, models, features, properties, id_, seed).drop("bin")
    clash = [p for p in properties if p in target.columns]
    return rows.drop(*clash).join(drawn, id_, "left")


def hold_out(df: DataFrame, edges: list[float], features: list[str], properties: list[str], id_: str, train_share: float = 0.8, seed: int = 0, min_rows: int = 50) -> DataFrame:
    """(id, bin, true_<p>, <p>): fitted on a random share of the rows, predicted for the others.

    The split is by a hash of the id, so it is the same at every run.
    """
    rows = with_bin(df, edges)
    train = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1_000_000)) < int(train_share * 1_000_000)
    models = fit(rows.where(train), features, properties, min_rows)
    test = rows.where(~train)
    drawn = predict(test, models, features, properties, id_, seed, refit=False)
    return drawn.join(test.select(id_, *[F.col(p).alias(f"true_{p}") for p in properties]), id_)


def to_json(models: dict[int, BinModel]) -> str:
    return json.dumps({str(b): vars(m) for b, m in models.items()})


def from_json(text: str) -> dict[int, BinModel]:
    return {int(b): BinModel(**m) for b, m in json.loads(text).items()}
