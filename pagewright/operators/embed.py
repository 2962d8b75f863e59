"""Texts to vectors: a lexical offline embedder that SQL can express, and the plug-in path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import words_of
from pagewright.functions.vectors import l2_normalize, let
from pagewright.plugins import Embedder


def hash_embedding(text: Column, dim: int = 64, max_tokens: int | None = None) -> Column:
    """Signed counts of lower-case words by their md5, length one; lexical, not semantic. All-zero for text without words. `max_tokens` takes the first words only, as a model's window does."""
    words = words_of(F.lower(F.coalesce(text, F.lit(""))))
    hashed = F.transform(words if max_tokens is None else F.slice(words, 1, max_tokens), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    slots = F.transform(hashed, lambda h: F.struct((h % dim).alias("i"), F.when((h / dim).cast("long") % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    return l2_normalize(let(slots, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(all_, lambda x: x["i"] == d), F.lit(0.0), lambda a, x: a + x["s"]))))


def embed_texts(df: DataFrame, make: Callable[[], Embedder], text: str = "text", into: str = "embedding", batch_size: int = 64, max_tokens: int | None = 128) -> DataFrame:
    """Adds vectors by a plug-in embedder, made once per worker and given `batch_size` texts at a time, each cut at `max_tokens` white-space tokens (None: whole)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for batch in batches:
            texts = [x if max_tokens is None else " ".join(x.split(None, max_tokens)[:max_tokens]) for x in batch.fillna("")]
            out: list[list[float]] = []
            for i in range(0, len(texts), batch_size):
                out += [list(map(float, v)) for v in embedder(texts[i : i + batch_size])]
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, run.asNondeterministic()(F.col(text)))


def mean_pool(tokens: DataFrame, key: str, vector: str = "embedding", mask: str | None = None, least: float = 1e-9) -> DataFrame:
    """(key, i, value): the masked mean of the vectors of each key by dimension (i from 0); combined before the shuffle."""
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    flat = tokens.select(key, weight.alias("_w"), F.posexplode(vector).alias("i", "x"))
    return flat.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(least))).alias("value"))
