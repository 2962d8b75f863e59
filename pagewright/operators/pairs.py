"""Question-passage pairs: column aliases, checks, generation, grouped splits."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import heuristic_questions

ALIASES = (("anchor", "positive"), ("query", "passage"), ("sentence1", "sentence2"))
# What a pair gets where the chunk table has no such column.
DEFAULTS = {"doc_id": "unknown", "section_id": "", "section_title": "", "page_start": 0, "page_end": 0, "token_count": 0, "char_count": 0}


def resolve_pair_columns(df: DataFrame, prefer: tuple[str, str] = ("anchor", "positive")) -> DataFrame:
    """(anchor, positive) as strings from the first pair of known names, `prefer` before the others; nulls become ''. ValueError names the columns found."""
    for a, b in (prefer, *[x for x in ALIASES if x != prefer]):
        if a in df.columns and b in df.columns:
            return df.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((a, "anchor"), (b, "positive"))])
    raise ValueError(f"no pair of text columns among {df.columns}")


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """One row: num_pairs, mean lengths, has_empty; zeros and false without pairs."""
    empty = (F.trim(F.coalesce("anchor", F.lit(""))) == "") | (F.trim(F.coalesce("positive", F.lit(""))) == "")
    mean = lambda c: F.round(F.coalesce(F.avg(F.char_length(F.coalesce(c, F.lit("")))), F.lit(0.0)), 6)
    return pairs.agg(F.count("*").alias("num_pairs"), mean("anchor").alias("avg_anchor_length"), mean("positive").alias("avg_positive_length"), F.coalesce(F.bool_or(empty), F.lit(False)).alias("has_empty"))


def generate_pairs(chunks: DataFrame, n: int = 3, questions: Callable[[Column, int], Column] = heuristic_questions) -> DataFrame:
    """(query, passage, doc_id, ...): one row per question of a chunk; missing columns get defaults."""
    col = lambda c: F.col(c) if c in chunks.columns else F.lit(DEFAULTS[c]).alias(c)
    chunk_id = F.col("chunk_id") if "chunk_id" in chunks.columns else F.concat(F.lit("chunk_"), F.monotonically_increasing_id().cast("string")).alias("chunk_id")
    return chunks.select(F.explode(questions(F.col("text"), n)).alias("query"), F.col("text").alias("passage"), col("doc_id"), chunk_id, *[col(c) for c in list(DEFAULTS)[1:]])


def grouped_split(pairs: DataFrame, val_ratio: float = 0.2, seed: int = 42, group_by: str = "chunk_id") -> DataFrame:
    """`pairs` with split_name: the groups first by a seeded hash are val, exactly ceil(val_ratio * groups) of them. ValueError if no group would be left for train.

    Without the group column every row is a group. The rank of groups is found by a histogram over hash prefixes and a count in one prefix, so no
    task sorts all groups.
    """
    if not 0 < val_ratio < 1:
        raise ValueError("val_ratio must lie between 0 and 1")
    if group_by not in pairs.columns:
        pairs = pairs.withColumn(group_by, F.monotonically_increasing_id())
    name = F.coalesce(F.col(group_by).cast("string"), F.lit("\x00"))
    hashed = F.md5(F.concat(name, F.lit(f"|{seed}")))
    groups = pairs.select(name.alias("_g"), hashed.alias("_h")).distinct()
    counts = groups.groupBy(F.substring("_h", 1, 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # at most 4096 rows
    total = sum(r.n for r in counts)
    wanted = math.ceil(val_ratio * total)
    if total and wanted >= total:
        raise ValueError("no group is left for train")
    before, last = 0, ""
    for r in counts:
        last = r.p
        if before + r.n >= wanted:
            break
        before += r.n
    edge = groups.where(F.substring("_h", 1, 3) == last).withColumn("r", F.row_number().over(Window.partitionBy(F.substring("_h", 1, 3)).orderBy("_h", "_g"))).where(F.col("r") <= wanted - before)
    val = groups.where(F.substring("_h", 1, 3) < last).select("_g").union(edge.select("_g")).withColumn("_v", F.lit(True))
    return pairs.withColumn("_g", name).join(val, "_g", "left").withColumn("split_name", F.when(F.col("_v"), "val").otherwise("train")).drop("_g", "_v")


def split_counts(split: DataFrame, group_by: str = "chunk_id") -> DataFrame:
    return split.groupBy("split_name").agg(F.count("*").alias("num_pairs"), F.count_distinct(group_by).alias("num_groups"))


def split_leaks(split: DataFrame, group_by: str = "chunk_id") -> DataFrame:
    """One row: how many groups are in more than one split."""
    per = split.groupBy(group_by).agg(F.count_distinct("split_name").alias("n"))
    return per.agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("num_leaks"))
