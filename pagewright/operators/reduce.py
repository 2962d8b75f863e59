"""Plane coordinates of vectors: principal components, t-SNE of a bounded sample, plot tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.similarity import _matrix

COLOURS = 8


def principal_axes(rows: DataFrame, vector: str = "embedding", n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): from sums and products gathered where the data lie; signs are fixed by each axis's largest entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, count = None, None, 0
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist())
            if x.size:
                total = x.sum(0) if total is None else total + x.sum(0)
                products = x.T @ x if products is None else products + x.T @ x
                count += len(x)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total.tolist()]), pa.array([products.ravel().tolist()])], names=["n", "s", "p"])

    parts = rows.where(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, "n long, s array<double>, p array<double>").collect()
    if not parts:
        return np.zeros(0), np.zeros((n, 0))
    count = sum(r.n for r in parts)
    mean = sum(np.array(r.s) for r in parts) / count
    cov = sum(np.array(r.p) for r in parts).reshape(len(mean), -1) / count - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :n].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def pca(rows: DataFrame, key: str, vector: str = "embedding", n: int = 2) -> DataFrame:
    """(key, x0, x1, ...): centred projections."""
    mean, axes = principal_axes(rows, vector, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist())
            y = (x - mean) @ axes.T if x.size else np.empty((0, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(y[:, i]) for i in range(n))], names=[key, *(f"x{i}" for i in range(n))])

    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, " + ", ".join(f"x{i} double" for i in range(n)))


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """Exact t-SNE in two dimensions from a principal-component start; perplexity is held under a third of the points."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    perplexity = max(1.0, min(perplexity, (n - 1) / 3))
    d = np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        own = np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(own - own.min()) * beta)
            q = e / e.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(entropy - np.log(perplexity)) < 1e-4:
                break
            low, high = (beta, high) if entropy > np.log(perplexity) else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    y = c @ vt[:2].T
    y = 1e-4 * y / max(1e-12, y[:, 0].std()) + np.random.default_rng(seed).normal(0, 1e-6, (n, 2))
    step, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(rounds):
        w = 1 / (1 + np.maximum(0, (y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T))
        np.fill_diagonal(w, 0)
        q = np.maximum(w / w.sum(), 1e-12)
        f = ((12 if t < 100 else 1) * p - q) * w
        g = 4 * (f.sum(1)[:, None] * y - f @ y)
        gain = np.maximum(0.01, np.where(np.sign(g) == np.sign(step), gain * 0.8, gain + 0.2))
        step = (0.5 if t < 100 else 0.8) * step - max(n / 48, 50) * gain * g
        y = y + step
    return y - y.mean(0)


def tsne_sample(rows: DataFrame, key: str, vector: str = "embedding", max_points: int = 1000, perplexity: float = 30.0) -> DataFrame:
    """(key, x0, x1) of at most `max_points` rows, those first by hash of the key; t-SNE is quadratic, so it is a picture of a sample by nature."""
    kind = dict(rows.dtypes)[key]
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(max_points).select(key, vector)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        y = tsne(_matrix(frame[vector]), perplexity)
        return pd.DataFrame({key: frame[key], "x0": y[:, 0], "x1": y[:, 1]})

    return sample.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, f"{key} {kind}, x0 double, x1 double")


def plot_table(points: DataFrame, pair: str, role: str) -> DataFrame:
    """(pair, role, x, y, colour): paired points for a plot, colours repeat after eight pairs."""
    return points.select(F.col(pair).alias("pair"), F.col(role).alias("role"), F.col("x0").alias("x"), F.col("x1").alias("y"), F.pmod(F.col(pair), F.lit(COLOURS)).cast("int").alias("colour"))


def scatter_table(points: DataFrame, label: str | None = None, marker: str | None = None) -> DataFrame:
    """(label, x, y, colour, marker): unpaired points for a plot; colours follow the order of the labels' hashes and repeat, a point without a marker gets a dot."""
    name = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return points.select(name.alias("label"), F.col("x0").alias("x"), F.col("x1").alias("y"), F.pmod(F.xxhash64(name), F.lit(COLOURS)).cast("int").alias("colour"), (F.coalesce(F.col(marker).cast("string"), F.lit("o")) if marker else F.lit("o")).alias("marker"))


def split_roles(points: DataFrame, role: str = "role", roles: tuple[str, str] = ("anchor", "positive")) -> tuple[DataFrame, DataFrame]:
    """The rows of the two roles that were stacked before, without the role."""
    return tuple(points.where(F.col(role) == r).drop(role) for r in roles)  # type: ignore[return-value]
