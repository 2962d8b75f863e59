"""Search by text: queries and documents are embedded, ranked by an index, and hits come with their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.embed import hash_embedding
from pagewright.operators.index import build_index


def lookup(rows: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by `order` of each key that `ids` names; unknown and null keys give none. Rows are combined by key before they meet the ids."""
    others = [c for c in rows.columns if c != key]
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_first"))
    return first.join(ids.select(key).distinct(), key).select(key, *[F.col("_first")[c].alias(c) for c in others])


def search_batch(queries: DataFrame, documents: DataFrame, top_k: int = 5, embed: Callable[[Column], Column] = hash_embedding, kind: str = "flat", query_id: str = "query_id", query: str = "query", row_id: str = "row_id", text: str = "document", **options) -> DataFrame:
    """(query_id, rank, row_id, similarity, document): the `top_k` most similar documents of each query, ties by row_id.

    `documents` may bring their vectors in `embedding`; else they are embedded as the queries are. Null texts are embedded as empty ones. Only the
    vectors are searched; the texts are fetched by id for the hits.
    """
    q = queries.select(F.col(query_id).alias("query_id"), embed(F.col(query)).alias("embedding"))
    vector = F.col("embedding") if "embedding" in documents.columns else embed(F.col(text))
    r = documents.select(F.col(row_id).alias("row_id"), vector.alias("embedding"))
    hits = build_index(kind)(q, r, k=top_k, **options)
    return hits.join(documents.select(F.col(row_id).alias("row_id"), F.col(text).alias("document")), "row_id").select("query_id", "rank", "row_id", "similarity", "document")


def search(query: str, documents: DataFrame, top_k: int = 5, **options) -> DataFrame:
    """(rank, row_id, similarity, document) of one query, the best first."""
    one = documents.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return search_batch(one, documents, top_k, **options).drop("query_id").orderBy("rank")
