"""Approximate search by inverted cells: vectors are ranged under their nearest centroid, queries visit the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.similarity import _matrix, _scaled, ranked

#: Rows of the sample on which centroids are fitted.
FIT_ROWS = 20_000
#: Queries on which the number of cells to visit is measured, and the share of their nearest rows that must lie in these cells.
FIT_QUERIES, FIT_RECALL = 400, 0.95


def n_cells(n: int) -> int:
    """At most 100, a tenth of the rows, at least one."""
    return max(1, min(100, n // 10))


def sampled(rows: DataFrame, n: int, vector: str, row_id: str) -> np.ndarray:
    """At most `n` vectors by hash of the id, of length one."""
    usable = rows.where(F.col(vector).isNotNull())
    return _scaled(_matrix(usable.orderBy(F.xxhash64(row_id), row_id).limit(n).select(vector).toPandas()[vector]), True)


def fit_centroids(rows: DataFrame, cells: int | None = None, vector: str = "embedding", row_id: str = "row_id", rounds: int = 15, sample: np.ndarray | None = None) -> np.ndarray:
    """Spherical k-means on a bounded sample by hash of the id; the same data give the same centroids."""
    x = sampled(rows, FIT_ROWS, vector, row_id) if sample is None else sample
    k = min(cells or n_cells(rows.where(F.col(vector).isNotNull()).count()), max(1, len(x)))
    if not len(x):
        return np.zeros((1, 1))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(0)
        c = _scaled(c, True)
    return c


def enough_probes(asked: np.ndarray, sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """The least number of cells in which FIT_RECALL of the k nearest sample rows of these queries lie. Rows equal to the query, such as itself, are
    always in its first cell and do not count. In more rows than the sample the nearest are nearer, so they lie in fewer cells."""
    if not len(asked) or not len(sample):
        return 1
    s = asked @ sample.T
    s[s > 1 - 1e-9] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    i, j = np.nonzero(np.isfinite(np.take_along_axis(s, top, axis=1)))
    if not len(i):
        return len(centroids)
    cell = np.argmax(sample @ centroids.T, axis=1)[top[i, j]]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")[i, cell]
    return int(np.sort(place)[int(np.ceil(FIT_RECALL * len(place))) - 1]) + 1


def assign(rows: DataFrame, centroids: np.ndarray, vector: str = "embedding", row_id: str = "row_id", probes: int = 1) -> DataFrame:
    """(id, v, cell): each vector under its `probes` nearest cells."""
    kind = dict(rows.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _scaled(_matrix(batch.column("v").to_pylist()), True) @ centroids.T
            p = min(probes, s.shape[1])
            cells = np.argsort(-s, axis=1, kind="stable")[:, :p]
            taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), p)))
            yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), pa.array(cells.ravel().astype(np.int32))], names=["id", "v", "cell"])

    source = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return source.mapInArrow(run, f"id {kind}, v array<double>, cell int")


def ivf_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, probes: int | None = None, cells: int | None = None, slice_rows: int = 50_000, query_id: str = "query_id", row_id: str = "row_id", vector: str = "embedding") -> DataFrame:
    """(query_id, row_id, similarity, rank). Every row is indexed; the centroids are fitted on a bounded sample. A cell with more than `slice_rows` rows is searched in slices.
    Without `probes`, as many cells are visited as a sample of the queries needs for a recall of FIT_RECALL."""
    sample = sampled(rows, FIT_ROWS, vector, row_id)
    centroids = fit_centroids(rows, cells, vector, row_id, sample=sample)
    probes = probes or enough_probes(sampled(queries, FIT_QUERIES, vector, query_id), sample, centroids, k)
    indexed = assign(rows, centroids, vector, row_id)
    slices = indexed.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    # one row a cell, of at most 100 cells
    n_slices = {r.cell: r.slices for r in slices.collect()}
    per_cell = F.create_map(*[F.lit(x) for pair in sorted(n_slices.items()) for x in pair]) if n_slices else F.create_map().cast("map<int,int>")
    parted = indexed.withColumn("part", F.pmod(F.xxhash64("id"), per_cell[F.col("cell")]).cast("int"))
    asked = assign(queries, centroids, vector, query_id, probes).withColumn("part", F.explode(F.sequence(F.lit(0), per_cell[F.col("cell")] - 1)))

    def visit(_key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a.id.to_numpy()[:0], "row_id": b.id.to_numpy()[:0], "similarity": np.empty(0)})
        s = _scaled(_matrix(a.v), True) @ _scaled(_matrix(b.v), True).T
        keep = np.ones(s.shape, bool)
        if len(b) > k:
            keep = s >= np.partition(s, -k, axis=1)[:, -k][:, None]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"query_id": a.id.to_numpy()[i], "row_id": b.id.to_numpy()[j], "similarity": s[i, j]})

    schema = f"query_id {dict(queries.dtypes)[query_id]}, row_id {dict(rows.dtypes)[row_id]}, similarity double"
    found = asked.groupBy("cell", "part").cogroup(parted.groupBy("cell", "part")).applyInPandas(visit, schema)
    return ranked(found).where(F.col("rank") <= k)


def available_index(*kinds: str):
    """The search of the first of these kinds that is at hand, None if none is. A kind `module:name` is the function `name` of an optional module."""
    for kind in kinds:
        module, _, name = kind.partition(":")
        if not name:
            return build_index(kind)
        try:
            return getattr(import_module(module), name)
        except (ImportError, AttributeError):
            continue
    return None


def build_index(kind: str):
    """The search of an index kind: flat (exact), ivf, or knn (exact, cosine distance); another kind is a ValueError."""
    from pagewright.operators.similarity import similarities

    if kind == "flat":
        return lambda q, r, k=5, **o: ranked(similarities(q, r, k=k, normalize=True, **o))
    if kind == "ivf":
        return ivf_top_k
    if kind == "knn":
        return lambda q, r, k=10, **o: ranked(similarities(q, r, k=k, normalize=True, **o)).withColumn("distance", 1 - F.col("similarity"))
    raise ValueError(f"no index of kind {kind!r}")
