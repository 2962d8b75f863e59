"""Lines repeated across the documents of one source, found over content-defined chunks (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut

#: Content-defined chunking: a cut falls before the letter whose rolling hash over the WINDOW bytes that begin there is the least within SPREAD bytes on either side.
WINDOW, SPREAD = 5, 7
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def source_of(path: Column) -> Column:
    """The folder that directly holds a file, letter case and kind of slash ignored; null where the path names none."""
    folder = F.regexp_extract(F.lower(F.translate(path, "\\", "/")), r"([^/]+)/+[^/]*$", 1)
    return F.when(folder != "", folder)


def letters_of(line: Column) -> Column:
    """A line lower-cased without every character that is not a letter."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk hashes, offsets into them by line) for lines that stand one behind the other in `data`, all at once.

    Cuts depend on nothing but the bytes around them and none is made near an end of a line, so equal lines give equal chunks whatever stands beside them.
    A chunk's hash also tells whether it begins and whether it ends its line; so a line of one chunk is equal to another where their chunks are.
    """
    n = len(data)
    starts, ends = offsets[:-1], offsets[1:]
    unit = data.astype(np.uint64) + np.uint64(1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(unit * powers(BASE, n), out=prefix[1:])
    back = powers(INVERSE, n + 1)
    rolling = np.full(n, np.iinfo(np.uint64).max)
    if n >= WINDOW:
        rolling[: n - WINDOW + 1] = mixed((prefix[WINDOW:] - prefix[:-WINDOW]) * back[: n - WINDOW + 1])
    least = rolling.copy()
    for k in range(1, SPREAD + 1):
        if k < n:
            np.minimum(least[k:], rolling[:-k], out=least[k:])
            np.minimum(least[:-k], rolling[k:], out=least[:-k])
    at = np.flatnonzero(least == rolling)
    line = np.searchsorted(ends, at, side="right")
    inside = (at - starts[np.minimum(line, len(starts) - 1)] >= SPREAD) & (ends[np.minimum(line, len(ends) - 1)] - at >= SPREAD + WINDOW) if len(starts) else np.zeros(0, bool)
    begin = np.sort(np.concatenate([starts[ends > starts], at[inside]]))
    begin = begin[np.concatenate([[True], begin[1:] != begin[:-1]])] if len(begin) else begin
    of_line = np.searchsorted(ends, begin, side="right")
    stop = np.minimum(np.append(begin[1:], n), ends[of_line]) if len(begin) else begin
    edges = 2 * (begin == starts[of_line]) + (stop == ends[of_line]) if len(begin) else begin
    hashes = mixed((prefix[stop] - prefix[begin]) * back[begin] + (4 * (stop - begin) + edges).astype(np.uint64))
    counts = np.bincount(of_line, minlength=len(starts))
    return hashes.view(np.int64), np.concatenate([[0], np.cumsum(counts)])


def chunked(lines: DataFrame) -> DataFrame:
    """(doc, page_id, line_no, letters) to the same with `chunks`, the chunk hashes of each line, for the letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("letters").cast(pa.large_binary())
            if not len(text):
                continue
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            hashes, at = chunk_hashes(data, offsets - offsets[0])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "page_id", "line_no")), lists], names=["doc", "page_id", "line_no", "chunks"])

    return lines.mapInArrow(run, "doc long, page_id bigint, line_no int, chunks array<long>")


def repeated_lines(pages: DataFrame, sections: DataFrame, least_documents: int = 3, least_share: float = 0.25) -> DataFrame:
    """(page_id, line_no) of every line of line_list that is repeated within its source.

    A line is repeated if its letters stand in at least `least_documents` documents and `least_share` of the source's documents that have pages.
    Distinct documents are counted by chunk and source. A line of one chunk is repeated if its chunk is. A longer one can only be if all its chunks
    are, the first of which is looked at before the others; what is left is counted by the sequence of its chunks, for chunks of different lines
    may meet in one. Documents, sources and chunks go by hashes of 64 bits.

    A document whose sections name several folders takes the first in byte order; pages of documents without a folder take part in nothing. Null
    lines, lines without letters and null or empty lists never count; a page delivered twice counts once. Empty tables give an empty result,
    further columns are ignored.
    """
    folders = sections.select(F.xxhash64("doc_id").alias("doc"), source_of(F.col("source_pdf")).alias("folder"), "doc_id").where("doc_id is not null and folder is not null").groupBy("doc").agg(F.xxhash64(F.min("folder")).alias("source"))
    documents = pages.where("doc_id is not null").select(F.xxhash64("doc_id").alias("doc")).distinct().join(folders, "doc")
    need = F.greatest(F.lit(least_documents), F.ceil(F.col("n_docs") * F.lit(least_share) - F.lit(1e-9))).cast("long")
    needs = documents.groupBy("source").agg(F.count("*").alias("n_docs")).select("source", need.alias("need"))

    lines = (
        pages.where("doc_id is not null and page_id is not null")
        .select(F.xxhash64("doc_id").alias("doc"), "page_id", F.posexplode("line_list").alias("pos", "line"))
        .select("doc", "page_id", (F.col("pos") + 1).cast("int").alias("line_no"), letters_of(F.col("line")).alias("letters"))
        .where("letters <> ''")
    )
    pieces = cut(chunked(lines).join(folders, "doc"))

    counted = pieces.select("source", "doc", F.explode("chunks").alias("chunk")).distinct().groupBy("source", "chunk").agg(F.count("*").alias("n"))
    frequent = counted.join(needs, "source").where("n >= need").select("source", "chunk")
    begun = cut(pieces.withColumn("chunk", F.element_at("chunks", 1)).join(frequent, ["source", "chunk"], "left_semi").drop("chunk"))
    whole = begun.where("size(chunks) = 1").select("page_id", "line_no")

    longer = begun.where("size(chunks) > 1").select("source", "doc", "page_id", "line_no", F.array_distinct(F.slice("chunks", F.lit(2), F.size("chunks") - 1)).alias("rest"), F.xxhash64("chunks").alias("sequence"))
    others = longer.select("source", "doc", "page_id", "line_no", "sequence", F.size("rest").alias("n_rest"), F.explode("rest").alias("chunk")).distinct().join(frequent, ["source", "chunk"], "left_semi")
    complete = cut(others.groupBy("source", "doc", "page_id", "line_no", "sequence", "n_rest").agg(F.count("*").alias("n")).where("n = n_rest").select("source", "doc", "page_id", "line_no", "sequence"))
    sequences = complete.select("source", "sequence", "doc").distinct().groupBy("source", "sequence").agg(F.count("*").alias("n")).join(needs, "source").where("n >= need").select("source", "sequence")
    return whole.union(complete.join(sequences, ["source", "sequence"], "left_semi").select("page_id", "line_no")).distinct()


def clean_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Every page once with `kept_lines`, its line_list without the lines found, and `n_removed`; null lists stay null."""
    cut = found.groupBy("page_id").agg(F.collect_set("line_no").alias("_cut"))
    kept = F.filter(F.transform("line_list", lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("line"))), lambda s: F.col("_cut").isNull() | ~F.array_contains("_cut", s["n"]))
    return (
        pages.select("page_id", "doc_id", "line_list")
        .where("page_id is not null")
        .dropDuplicates(["page_id"])
        .join(cut, "page_id", "left")
        .select("page_id", "doc_id", F.transform(kept, lambda s: s["line"]).alias("kept_lines"), F.coalesce(F.size("_cut"), F.lit(0)).alias("n_removed"))
    )
