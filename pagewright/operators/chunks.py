"""Token-bounded, overlapping chunks of sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import alnum_ratio, split_sentences
from pagewright.plugins import TokenCounter, whitespace_tokens

COLUMNS = ("doc_id", "chunk_id", "section_id", "section_title", "page_start", "page_end", "token_count", "char_count", "text")


def pack_sentences(sentences: list[str], max_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 128, count: TokenCounter = whitespace_tokens) -> list[str]:
    """Greedy packing: a chunk closes when the next sentence would overflow it, the next one begins with the longest tail that fits the overlap; then a small chunk merges with its successor within 1.2 times the maximum."""
    sized = [(s, count(s)) for s in sentences]
    chunks: list[str] = []
    current: list[tuple[str, int]] = []
    total = 0
    for s, n in sized:
        if current and total + n > max_tokens:
            chunks.append(" ".join(x for x, _ in current))
            kept, room = [], overlap_tokens
            while current and current[-1][1] <= room:
                room -= current[-1][1]
                kept.append(current.pop())
            current, total = kept[::-1], overlap_tokens - room
        current.append((s, n))
        total += n
    if current:
        chunks.append(" ".join(x for x, _ in current))
    merged: list[str] = []
    waiting: str | None = None
    for c in chunks:
        if waiting is not None and count(waiting) < min_tokens and count(f"{waiting} {c}") <= max_tokens * 1.2:
            merged.append(f"{waiting} {c}")
            waiting = None
        else:
            if waiting is not None:
                merged.append(waiting)
            waiting = c
    return merged if waiting is None else [*merged, waiting]


def pack_column(sentences: Column, max_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 128, count: TokenCounter = whitespace_tokens) -> Column:
    """ARRAY<STRUCT<text, tokens>> of the chunks. The fold depends on order and on a tokenizer of any kind, so it runs in Arrow batches."""
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType())]))

    @F.pandas_udf(kind)
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"text": c, "tokens": count(c)} for c in pack_sentences(list(s), max_tokens, overlap_tokens, min_tokens, count)] if s is not None else [] for s in batch])

    return pack.asNondeterministic()(sentences)  # else each use of a chunk packs again


def chunk_sections(sections: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 128, least_alnum: float = 0.3, count: TokenCounter = whitespace_tokens) -> DataFrame:
    """The chunk table. Chunks are numbered before those with too few letters and digits are dropped, so numbers may have gaps; pages are the section's."""
    packed = sections.select("doc_id", "section_idx", "section_id", F.col("title").alias("section_title"), "page_start", "page_end", pack_column(split_sentences(F.col("text")), max_tokens, overlap_tokens, min_tokens, count).alias("c"))
    rows = packed.select("doc_id", "section_idx", "section_id", "section_title", "page_start", "page_end", F.posexplode("c").alias("chunk_idx", "c"))
    rows = rows.select("*", F.col("c.text").alias("text"), F.col("c.tokens").alias("token_count")).where(alnum_ratio(F.col("text")) >= F.lit(float(least_alnum)))
    chunk_id = F.format_string("%s::sec%03d::chunk%05d", "doc_id", "section_idx", "chunk_idx")
    return rows.withColumn("chunk_id", chunk_id).withColumn("char_count", F.char_length("text").cast("int")).select(*COLUMNS)


def chunk_stats(chunks: DataFrame, n_pages: Column | int, n_sections: Column | int) -> DataFrame:
    """One row of statistics; zeros without chunks. The median is exact."""
    zero = F.lit(0)
    return chunks.agg(
        F.count("*").alias("num_chunks"),
        F.coalesce(F.sum("token_count"), zero).alias("total_tokens"),
        F.round(F.coalesce(F.avg("token_count"), F.lit(0.0)), 6).alias("avg_tokens_per_chunk"),
        F.coalesce(F.min("token_count"), zero).cast("long").alias("min_tokens"),
        F.coalesce(F.median("token_count"), F.lit(0.0)).cast("double").alias("median_tokens"),
        F.coalesce(F.max("token_count"), zero).cast("long").alias("max_tokens"),
    ).select((n_pages if isinstance(n_pages, Column) else F.lit(n_pages)).cast("long").alias("num_pages"), (n_sections if isinstance(n_sections, Column) else F.lit(n_sections)).cast("long").alias("num_sections"), "*")
