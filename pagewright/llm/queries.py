"""The queries pN_... over the delivered tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import cross_split, grouped_splits, mixing, neighbours, packing, pair_defects, quality, repeated_lines, scan_repair
from pagewright.operators.similarity import similarities
from pagewright.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits.record_groups(table(spark, sf_dir, "pairs_df"), table(spark, sf_dir, "doc_catalog"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its split, no group in two splits."""
    pairs = table(spark, sf_dir, "pairs_df").select("pair_id", "doc_id", "chunk_id", "src")
    grouped = p1_found(spark, sf_dir).join(pairs.select("pair_id", "src").dropDuplicates(["pair_id"]), "pair_id")
    return grouped_splits.grouped_splits(grouped, table(spark, sf_dir, "split_targets"))


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p1_splits: each split within 0.02 of its share of all records, no group in two."""
    placed = cut(p1_splits(spark, sf_dir))
    targets = table(spark, sf_dir, "split_targets")
    n, total = placed.count(), targets.agg(F.sum("target_share")).first()[0]
    groups = p1_found(spark, sf_dir).join(placed, "pair_id").where("group_doc is not null").groupBy("group_doc").agg(F.count_distinct("split_name").alias("n"))
    torn = groups.agg(F.count_if(F.col("n") > 1).alias("torn_groups"))
    got = targets.join(placed.groupBy("split_name").agg(F.count("*").alias("n")), "split_name", "left")
    return got.select("split_name", (F.abs(F.coalesce("n", F.lit(0)) / n - F.col("target_share") / total) <= 0.02).alias("near_target")).crossJoin(torn)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "chunk_embeddings")).select("chunk_id_a", "chunk_id_b")


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of every vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "chunk_embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of p2_nearest against the exact neighbours of the same query set."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = table(spark, sf_dir, "chunk_embeddings").where(F.col("chunk_id").isNotNull() & (F.size("embedding") == 96) & finite & F.exists("embedding", lambda x: x != 0))
    rows = usable.select(F.col("chunk_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["row_id"])
    asked = usable.where("vec_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["query_id"])
    want = similarities(asked, rows, k=10, normalize=True, not_self=True).select("query_id", F.col("row_id").alias("chunk_id"), F.lit(1).alias("wanted"))
    got = p2_nearest(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("got"))
    met = want.join(got, ["query_id", "chunk_id"], "full")
    return met.agg(F.count_distinct("query_id").alias("n_queries"), F.count("got").alias("n_hits"), (F.count_if(F.col("wanted").isNotNull() & F.col("got").isNotNull()) >= 0.9 * F.count("wanted")).alias("recall_090"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "doc_sections"))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without the lines repeated in its source."""
    pages = repeated_lines.clean_pages(table(spark, sf_dir, "pdf_pages"), p3_found(spark, sf_dir))
    return pages.select("page_id", "doc_id", F.array_join("kept_lines", "\n").alias("text"), "n_removed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.page_noise(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "doc_catalog"))


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as repaired, continuous paragraphs."""
    return scan_repair.repaired_pages(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "doc_catalog"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as continuous paragraphs over its pages."""
    return scan_repair.document_paragraphs(p4_pages(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split.cross_split_pairs(table(spark, sf_dir, "pairs_df")).select("pair_id_a", "pair_id_b")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping records and pairs per split and source."""
    pairs = table(spark, sf_dir, "pairs_df")
    return cross_split.overlap_report(pairs, p5_found(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.find_defects(table(spark, sf_dir, "pairs_df"), table(spark, sf_dir, "common_words"))


def p6_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of p6_found the pairs with nothing for an answer."""
    return p6_found(spark, sf_dir).where("defect = 'empty'").select("pair_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document, or piece of one, lies in the windows of each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window with its number of items and fill."""
    return packing.windows(p7_items(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, items, tokens and mean fill of each capacity."""
    return packing.fill_report(p7_items(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_items: every document that has tokens in every container, no window over its capacity, no gap or overlap in one, nothing cut that fits whole."""
    caps = table(spark, sf_dir, "pack_capacities")
    items = cut(p7_items(spark, sf_dir)).join(F.broadcast(caps.limit(1000)), "container")
    docs = items.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.first("capacity_tokens").alias("cap"))
    per_doc = docs.groupBy("container").agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("cap"))).alias("n_cut_needlessly"))
    full = items.groupBy("container", "stream", "window").agg(F.sum("tokens").alias("tokens"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.first("capacity_tokens").alias("cap"))
    per_window = full.groupBy("container").agg(F.count_if(F.col("tokens") > F.col("cap")).alias("n_over"), F.count_if(F.col("end") != F.col("tokens")).alias("n_gaps"), (F.avg(F.col("tokens") / F.col("cap")) > 0.9).alias("well_filled"))
    return per_doc.join(per_window, "container")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p8: shares within 0.01 of the targets of the sources that have tokens, no repeat above the cap, no document of another source."""
    drawn, shares = mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    present = shares.agg(F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")))).first()[0]
    most = drawn.groupBy("source").agg(F.max("repeats").alias("most"))
    want = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.lit(present)).otherwise(F.lit(0.0))
    return shares.join(most, "source", "left").select("source", (F.abs(F.col("share") - want) <= 0.01).alias("near_target"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"))


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their repeats."""
    return mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its statistics, kind and the reason of a failure."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_statistics(documents, table(spark, sf_dir, "common_words")).drop("text")


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of p9_stats what plain counting gives."""
    return p9_stats(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "punct_line_share", "bullet_share")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_stats(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_check": p1_check,
    "p2_found": p2_found,
    "p2_nearest": p2_nearest,
    "p2_recall": p2_recall,
    "p3_found": p3_found,
    "p3_pages": p3_pages,
    "p4_found": p4_found,
    "p4_pages": p4_pages,
    "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_empty": p6_empty,
    "p7_items": p7_items,
    "p7_windows": p7_windows,
    "p7_fill": p7_fill,
    "p7_check": p7_check,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
    "p9_counts": p9_counts,
}
