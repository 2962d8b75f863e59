"""Exact similarity of a stated query set against all rows, rankings and their measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries up to this number go to every task; more are taken in blocks of this size, each meeting slices of all rows.
BLOCK = 4096
#: Rows of a slice, and queries multiplied with it at once: a product holds at most 512 x 16,384 numbers.
SLICE_ROWS, AT_ONCE = 16_384, 512


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64) if len(column) else np.empty((0, 0))


def _scaled(x: np.ndarray, normalize: bool) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalize and x.size else x


def similarities(queries: DataFrame, rows: DataFrame, least: float | None = None, k: int | None = None, normalize: bool = False, query_id: str = "query_id", row_id: str = "row_id", vector: str = "embedding", block: int = BLOCK, not_self: bool = False, digits: int | None = None, unlike: str | None = None) -> DataFrame:
    """(query_id, row_id, similarity): dot products of all queries with all rows, in matrix blocks.

    `least` and `k` cut within each batch of rows already; with `k` the result holds the k best rows of each query, ties by row id. Up to `block`
    queries are sent to the tasks, their number being checked first; beyond that rows and blocks of queries are grouped. Rows and queries with
    a null vector take no part. `not_self` leaves out rows whose id is the query's. With `digits` the similarities are rounded before any cut,
    so that equal vectors tie whatever batch they are in. `unlike` names a column of both sides: rows that have the query's value in it are left
    out, and so are pairs with a null in it.
    """
    spark = rows.sparkSession
    kind = F.col(unlike) if unlike else F.lit(0)
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"), kind.alias("kind"))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(vector).alias("v"), kind.alias("kind"))
    if unlike:
        q, r = q.where("kind is not null"), r.where("kind is not null")
    q_type, r_type = dict(q.dtypes)["query_id"], dict(r.dtypes)["row_id"]
    schema = f"query_id {q_type}, row_id {r_type}, similarity double"

    def score(q_ids: np.ndarray, q_vectors: np.ndarray, q_kinds: np.ndarray, r_ids: np.ndarray, r_vectors: np.ndarray, r_kinds: np.ndarray) -> pd.DataFrame:
        if not len(q_ids) or not len(r_ids):
            return pd.DataFrame({"query_id": q_ids[:0], "row_id": r_ids[:0], "similarity": np.empty(0)})
        a, b = _scaled(q_vectors, normalize), _scaled(r_vectors, normalize)
        return pd.concat([some(q_ids[i : i + AT_ONCE], a[i : i + AT_ONCE], q_kinds[i : i + AT_ONCE], r_ids, b, r_kinds) for i in range(0, len(q_ids), AT_ONCE)])

    def some(q_ids: np.ndarray, a: np.ndarray, q_kinds: np.ndarray, r_ids: np.ndarray, b: np.ndarray, r_kinds: np.ndarray) -> pd.DataFrame:
        s = a @ b.T
        if digits is not None:
            s = np.round(s, digits)
        keep = np.ones(s.shape, bool) if least is None else s >= least
        if not_self:
            keep &= q_ids[:, None] != r_ids[None, :]
        if unlike:
            keep &= q_kinds[:, None] != r_kinds[None, :]
        if k is not None and len(r_ids) > k:
            floor = np.partition(np.where(keep, s, -np.inf), -k, axis=1)[:, -k]
            keep &= s >= floor[:, None]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"query_id": q_ids[i], "row_id": r_ids[j], "similarity": s[i, j]})

    few = q.limit(block + 1).toPandas()
    if len(few) <= block:
        shared = spark.sparkContext.broadcast((few.query_id.to_numpy(), _matrix(few.v), few.kind.to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, kinds = shared.value
            for batch in batches:
                if batch.num_rows:
                    frame = batch.to_pandas()
                    yield pa.RecordBatch.from_pandas(score(ids, vectors, kinds, frame.row_id.to_numpy(), _matrix(frame.v), frame.kind.to_numpy()), preserve_index=False)

        out = r.mapInArrow(run, schema)
    else:
        parts = max(1, -(-q.count() // block))
        blocks = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        slices = max(1, -(-r.count() // SLICE_ROWS))
        spread = r.withColumn("c", F.pmod(F.xxhash64("row_id"), F.lit(slices)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        asked = blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        def meet(_key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return score(a.query_id.to_numpy(), _matrix(a.v), a.kind.to_numpy(), b.row_id.to_numpy(), _matrix(b.v), b.kind.to_numpy())

        out = asked.groupBy("b", "c").cogroup(spread.groupBy("b", "c")).applyInPandas(meet, schema)
    return out if k is None else ranked(out).where(F.col("rank") <= k).drop("rank")


def ranked(scores: DataFrame) -> DataFrame:
    """Adds `rank` from 1 by falling similarity within the query, ties by row id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")))


def own_ranks(scores: DataFrame, own: Column) -> DataFrame:
    """(query_id, rank): where the row that belongs to each query stands, counted without a sort: rows before it and equal ones of smaller id."""
    mine = scores.where(own).select("query_id", F.col("row_id").alias("own_id"), F.col("similarity").alias("own_similarity"))
    ahead = (F.col("similarity") > F.col("own_similarity")) | ((F.col("similarity") == F.col("own_similarity")) & (F.col("row_id") < F.col("own_id")))
    return scores.join(mine, "query_id").groupBy("query_id").agg((1 + F.sum(ahead.cast("int"))).alias("rank"))


def accuracy_and_mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def evaluate_retrieval(top: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row: precision at 1, at k (by the smaller of k and the number of hits), and MRR cut at k, over all queries; `top` has ranks, `relevant` (query_id, row_id)."""
    hits = top.where(F.col("rank") <= k).join(relevant.select("query_id", "row_id").distinct().withColumn("rel", F.lit(1)), ["query_id", "row_id"], "left")
    rel = F.coalesce("rel", F.lit(0))
    per = hits.groupBy("query_id").agg(
        F.max(((F.col("rank") == 1) & (rel == 1)).cast("double")).alias("p1"),
        (F.sum(rel) / F.least(F.lit(k), F.count("*"))).alias("pk"),
        F.coalesce(1.0 / F.min(F.when(rel == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    full = queries.select("query_id").distinct().join(per, "query_id", "left")
    return full.agg(F.avg(F.coalesce("p1", F.lit(0.0))).alias("precision_at_1"), F.avg(F.coalesce("pk", F.lit(0.0))).alias(f"precision_at_{k}"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"))


def hard_negatives(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows other than the query's own with similarity >= threshold, the most similar first, ties by query and row."""
    return scores.where((F.col("similarity") >= threshold) & (F.col("query_id") != F.col("row_id"))).orderBy(F.desc("similarity"), "query_id", "row_id")
