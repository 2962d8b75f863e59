"""Repeated headers and footers of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import split_lines, strip_ws


def non_empty_pages(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """The pages whose text holds more than white space."""
    return pages.where(strip_ws(F.coalesce(F.col(text), F.lit(""))) != "")


def lines_or_text(pages: DataFrame) -> Column:
    """line_list, or the lines of cleaned_text where it is null or empty."""
    return F.when(F.coalesce(F.size("line_list"), F.lit(0)) > 0, F.col("line_list")).otherwise(split_lines(F.col("cleaned_text")))


def edge_counts(pages: DataFrame, top: int = 3, bottom: int = 3) -> DataFrame:
    """(doc_id, zone, line, cnt): how often each line stands among the first or last lines of a document's pages; shorter pages do not vote. Counts are combined before the shuffle."""
    lines = pages.select("doc_id", lines_or_text(pages).alias("l"))
    zones = F.array(
        F.struct(F.lit("header").alias("zone"), F.when(F.size("l") >= top, F.slice("l", 1, top)).alias("lines")),
        F.struct(F.lit("footer").alias("zone"), F.when(F.size("l") >= bottom, F.slice("l", -bottom, bottom)).alias("lines")),
    )
    flat = lines.select("doc_id", F.explode(zones).alias("z")).select("doc_id", "z.zone", F.explode("z.lines").alias("line"))
    return flat.groupBy("doc_id", "zone", "line").agg(F.count("*").alias("cnt"))


def repeated_edges(pages: DataFrame, top: int = 3, bottom: int = 3, threshold: float = 0.6, min_repeat: int = 0) -> DataFrame:
    """The lines of edge_counts that reach int(threshold * pages of the document); `min_repeat` spares short documents, on which that is one page or none."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    cut = F.greatest((F.lit(threshold) * F.col("n")).cast("int"), F.lit(min_repeat))
    return edge_counts(pages, top, bottom).join(n, "doc_id").where(F.col("cnt") >= cut).select("doc_id", "zone", "line", "cnt")


def strip_headers_footers(pages: DataFrame, top: int = 3, bottom: int = 3, threshold: float = 0.6, min_repeat: int = 0) -> DataFrame:
    """`pages` with line_list and cleaned_text without the leading lines that are repeated headers and the trailing ones that are repeated footers.

    Lines meet the repeated ones by document and line, so a document with any number of pages or repeated lines is no single group.
    """
    repeated = repeated_edges(pages, top, bottom, threshold, min_repeat)
    sets = repeated.groupBy("doc_id").agg(F.collect_set(F.when(F.col("zone") == "header", F.col("line"))).alias("_h"), F.collect_set(F.when(F.col("zone") == "footer", F.col("line"))).alias("_f"))
    empty = F.array().cast("array<string>")
    j = pages.withColumn("_l", lines_or_text(pages)).join(sets, "doc_id", "left").withColumn("_h", F.coalesce("_h", empty)).withColumn("_f", F.coalesce("_f", empty))
    marks = F.transform("_l", lambda x, i: F.struct((i + 1).alias("i"), F.array_contains("_h", x).alias("h"), F.array_contains("_f", x).alias("f")))
    first = F.array_min(F.transform(F.filter(marks, lambda m: ~m["h"]), lambda m: m["i"]))
    last = F.array_max(F.transform(F.filter(marks, lambda m: ~m["f"]), lambda m: m["i"]))
    kept = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_b") >= F.col("_a")), F.slice("_l", F.col("_a"), F.col("_b") - F.col("_a") + 1)).otherwise(empty)
    out = j.withColumn("_a", first).withColumn("_b", last).withColumn("line_list", kept).withColumn("cleaned_text", F.array_join("line_list", "\n"))
    return out.select(*pages.columns) if {"line_list", "cleaned_text"} <= set(pages.columns) else out.drop("_l", "_h", "_f", "_a", "_b")


def clean_pages(pages: DataFrame, **options) -> DataFrame:
    """raw_text to normalised cleaned_text and line_list without repeated headers and footers."""
    from pagewright.functions.text import normalize_text

    text = pages.withColumn("cleaned_text", normalize_text(F.col("raw_text")))
    return strip_headers_footers(text.withColumn("line_list", split_lines(F.col("cleaned_text"))), **options)
