"""Sections of documents by headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import heading_score, section_level, strip_ws
from pagewright.session import cut


def numbered_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, line): every line of every page; (page_number, pos) is its order in the document."""
    return pages.select("doc_id", "page_number", F.posexplode("line_list").alias("pos", "line"))


def detect_headings(lines: DataFrame, min_score: float = 0.4) -> DataFrame:
    """`lines` with their score, only those that are headings."""
    return lines.withColumn("score", heading_score(F.col("line"))).where(F.col("score") >= F.lit(float(min_score)))


def prefix_sums(rows: DataFrame, key: str, order: str, value: str, width: int = 1024) -> DataFrame:
    """`rows` with `before` and `total`: the sums of `value` over the rows of the same key with a smaller whole number `order`, and over all of them.

    Rows are ordered within ranges of `width` numbers and only the ranges' sums within a key, so no task orders a key that holds much of the rows.
    """
    ranged = rows.withColumn("_r", F.floor(F.col(order) / width))
    sums = ranged.groupBy(key, "_r").agg(F.sum(value).alias("_s"))
    by_range = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_r", F.coalesce(F.sum("_s").over(by_range), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(key)).alias("total"))
    within = Window.partitionBy(key, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_w", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [key, "_r"]).withColumn("before", F.col("_b") + F.col("_w")).drop("_r", "_b", "_w")


def build_sections(pages: DataFrame, min_score: float = 0.4, keep_preamble: bool = False, deepest_first: bool = False) -> DataFrame:
    """(doc_id, section_idx, section_id, title, sec_level, page_start, page_end, text).

    A section is a heading with the lines up to the next; lines before the first are dropped unless `keep_preamble`. A document without
    headings gives one section a page (blank ones too), or a single one named Document if it has one page; one without any line gives none.
    Page numbers must be unique within a document. A page's lines are cut at its headings and travel as these pieces, those of no section
    not at all; no task holds more of a document than one section, or orders more than 1024 of its pages.
    """
    flags = F.transform("line_list", lambda x: heading_score(x) >= F.lit(float(min_score)))
    starts = F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())
    # the pages are used several times below: written once, they are cleaned and scored once
    pages = scored = cut(pages.select("doc_id", "page_number", "cleaned_text", "line_list", starts.alias("starts")))
    counted = scored.select("doc_id", "page_number", F.coalesce(F.size("starts"), F.lit(0)).alias("n"))
    before = prefix_sums(counted, "doc_id", "page_number", "n").select("doc_id", "page_number", "before", "total")
    # piece 0 stands before the page's first heading and belongs to the section open so far, piece j begins with heading j
    begin = F.concat(F.array(F.lit(1)), "starts")
    end = F.concat("starts", F.array(F.size("line_list") + 1))
    pieces = F.zip_with(begin, end, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    cut_up = scored.where("size(line_list) > 0").join(before.where("total > 0"), ["doc_id", "page_number"]).select("doc_id", "page_number", "line_list", "before", F.posexplode(pieces).alias("j", "p"))
    marked = cut_up.where("p.n > 0").select("doc_id", "page_number", "j", (F.col("before") + F.col("j")).alias("sec"), F.slice("line_list", F.col("p.a"), F.col("p.n")).alias("lines"))
    if not keep_preamble:
        marked = marked.where("sec > 0")
    headed = marked.groupBy("doc_id", "sec").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "j", "lines"))), lambda s: s["lines"])).alias("l"))
    first = strip_ws(F.col("l")[0])
    headed = headed.select(
        "doc_id",
        (F.col("sec") - 1).cast("int").alias("section_idx"),
        F.when(F.col("sec") == 0, "sec_preamble").otherwise(F.format_string("sec_%03d", F.col("sec") - 1)).alias("section_id"),
        first.alias("title"),
        section_level(first, deepest_first).alias("sec_level"),
        "page_start",
        "page_end",
        F.array_join("l", "\n").alias("text"),
    )
    bare_pages = before.where("total = 0").select("doc_id", "page_number").join(pages, ["doc_id", "page_number"]).withColumn("n", F.coalesce(F.size("line_list"), F.lit(0))).withColumn("one", F.lit(1))
    sums = bare_pages.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count("*").alias("pages"))
    bare = prefix_sums(bare_pages.select("doc_id", "page_number", "cleaned_text", "one"), "doc_id", "page_number", "one").join(sums.where("lines > 0"), "doc_id")
    single = F.col("pages") == 1
    bare = bare.select(
        "doc_id",
        F.col("before").cast("int").alias("section_idx"),
        F.when(single, "sec_001").otherwise(F.format_string("sec_page_%03d", "page_number")).alias("section_id"),
        F.when(single, "Document").otherwise(F.format_string("Page %d", "page_number")).alias("title"),
        F.lit(1).alias("sec_level"),
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        F.coalesce("cleaned_text", F.lit("")).alias("text"),
    )
    return headed.unionByName(bare)
