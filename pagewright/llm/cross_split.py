"""Same or near-same records across splits: an inverted join of the rarest shingles of each passage, exact verification (problem 5)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import cut

SHINGLE = 3
#: Size of the sketch that counts in how many distinct passages a shingle occurs; 4 MB whatever the data.
SKETCH_BITS, BLOCKS = 20, 64
#: How many of their rarest shingles two passages must share to be compared; a higher number makes each prefix as much longer and the candidates fewer.
SHARED = 6


def plain_words(texts: pa.Array) -> pa.Array:
    """The runs of letters and digits, lower case, joined by single spaces."""
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\p{L}\p{N}]+", " "), " ")


def query_key(text: str | None) -> str | None:
    """Letters and digits only, without case, accents and compatibility forms; None where nothing is left."""
    if not text:
        return None
    flat = text.casefold() if text.isascii() else unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return re.sub(r"[\W_]+", "", "".join(c for c in flat if not unicodedata.combining(c))) or None


def word_keys(records: DataFrame, least_words: int) -> DataFrame:
    """(pair_id, side, key, q): a 128-bit key of the words of each passage of enough words, null for others, and the query's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = plain_words(batch.column("passage"))
            enough = pc.fill_null(pc.greater_equal(pc.count_substring(words, " "), least_words - 1), False).to_pylist()
            keys = [xxhash.xxh3_128_digest(w.encode()) if ok and w else None for w, ok in zip(words.to_pylist(), enough)]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("side"), pa.array(keys, pa.binary()), pa.array([query_key(q) for q in batch.column("query").to_pylist()], pa.string())], names=["pair_id", "side", "key", "q"])

    kind = dict(records.dtypes)["pair_id"]
    return records.select("pair_id", "side", "passage", "query").mapInArrow(run, f"pair_id {kind}, side string, key binary, q string")


def word_classes(records: DataFrame, least_words: int) -> DataFrame:
    """(key, words, pair_id, side) of the passages of enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = plain_words(batch.column("passage"))
            enough = pc.and_(pc.fill_null(pc.greater_equal(pc.count_substring(words, " "), least_words - 1), False), pc.fill_null(pc.greater(pc.binary_length(words), 0), False))
            words, rows = words.filter(enough), batch.filter(enough)
            keys = [xxhash.xxh3_128_digest(w.encode()) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), words.cast(pa.string()), rows.column("pair_id"), rows.column("side")], names=["key", "words", "pair_id", "side"])

    kind = dict(records.dtypes)["pair_id"]
    return records.select("pair_id", "side", "passage").mapInArrow(run, f"key binary, words string, pair_id {kind}, side string")


class Shingler:
    """Distinct shingle hashes of a text of plain words; word hashes are remembered within a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        ids = []
        for w in text.split(" "):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids.append(h)
        x = np.array(ids, np.uint64)
        if len(x) < SHINGLE:
            return np.empty(0, np.uint64)
        h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + (x[1:-1] ^ (x[1:-1] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + (x[2:] ^ (x[2:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return np.unique(h ^ (h >> np.uint64(33)))


def shingle_counts(classes: DataFrame) -> tuple[np.ndarray, int]:
    """(sketch, number of passages): for each hash bucket, how many distinct passages hold a shingle in it. Summed in the cluster, block by block."""
    width = (1 << SKETCH_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, shingles = np.zeros(1 << SKETCH_BITS, np.int64), 0, Shingler()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, (shingles(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(BLOCKS)], pa.binary())], names=["block", "n", "counts"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for x in rows.counts:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"block": [key[0]], "n": [int(rows.n.sum())], "counts": [total.tobytes()]})

    schema = "block int, n long, counts binary"
    rows = classes.select("words").mapInArrow(count, schema).groupBy("block").applyInPandas(add, schema).collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        sketch[r.block * width : (r.block + 1) * width] = np.frombuffer(bytes(r.counts), np.int64)
    return sketch, max((r.n for r in rows), default=0)


def needed(n: int | Column, least_overlap: float) -> int | Column:
    """How many shingles a set of n must have in common with one that is not larger."""
    return F.ceil(n * least_overlap - 1e-9) if isinstance(n, Column) else int(np.ceil(n * least_overlap - 1e-9))


def prefixes(classes: DataFrame, sketch: np.ndarray, n: int, least_overlap: float) -> DataFrame:
    """(class, size, left, shingle): the rarest shingles of each class of equal passages, with how many of its shingles follow in the order of rarity.

    All sets follow one order: by the sketch's count, ties by hash. Of `needed` common shingles or more, the first SHARED have at least
    `needed` - SHARED others behind them, so they stand among the first size - needed + SHARED of either set. No pair is missed, however
    frequent its shingles are; counts that are too high by collisions only make the order a worse one.
    """
    shared = classes.sparkSession.sparkContext.broadcast(sketch.astype(np.int32) if n < 2**31 else sketch)  # 4 or 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingler = shared.value, Shingler()
        for batch in batches:
            taken, at, size, left = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for k, text in enumerate(batch.column("words").to_pylist()):
                s = shingler(text)
                first = s[np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[: len(s) - needed(len(s), least_overlap) + SHARED]]
                taken.append(first)
                at.append(np.full(len(first), k))
                size.append(np.full(len(first), len(s), np.int32))
                left.append(np.arange(len(s) - 1, len(s) - 1 - len(first), -1, dtype=np.int32))
            columns = [batch.column("class").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(size)), pa.array(np.concatenate(left)), pa.array(np.concatenate(taken).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "size", "left", "shingle"])

    return classes.select("class", "words").mapInArrow(run, "class long, size int, left int, shingle long")


@F.pandas_udf(T.DoubleType())
def overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Shingles in common divided by the larger number of shingles; a text's shingles are remembered, for it has several candidates in a row."""
    shingles = lru_cache(maxsize=4096)(Shingler())
    for one, other in batches:
        out = []
        for x, y in zip(one, other):
            a, b = shingles(x), shingles(y)
            out.append(len(np.intersect1d(a, b, assume_unique=True)) / max(len(a), len(b), 1))
        yield pd.Series(out, dtype="float64")


def near_classes(classes: DataFrame, least_overlap: float) -> DataFrame:
    """(c1, c2), c1 < c2: classes with near-same words of which one is in train and the other held out."""
    sketch, n = shingle_counts(classes)
    one = prefixes(classes.where("trained"), sketch, n, least_overlap)
    other = prefixes(classes.where("held"), sketch, n, least_overlap).select("shingle", F.col("class").alias("class2"), F.col("size").alias("size2"), F.col("left").alias("left2"))
    need = needed(F.greatest("size", "size2"), least_overlap)
    # sizes that differ too much are out, and so are shingles behind which too few are left to be among the first SHARED of `need` common ones
    within = (F.col("class") != F.col("class2")) & (F.least("size", "size2") >= need) & (F.least("left", "left2") + SHARED >= need)
    met = one.join(other, "shingle").where(within).groupBy("class", "class2").agg(F.count("*").alias("shared"), F.first(need).alias("need"))
    candidates = met.where(F.col("shared") >= F.least(F.lit(SHARED), "need")).select(F.least("class", "class2").alias("c1"), F.greatest("class", "class2").alias("c2")).distinct()
    # the words are fetched by class and shingled after the join, so that only texts with a candidate are shuffled as such
    words = classes.select("class", "words")
    met = candidates.join(words.select(F.col("class").alias("c1"), F.col("words").alias("w1")), "c1").join(words.select(F.col("class").alias("c2"), F.col("words").alias("w2")), "c2")
    return cut(met.where(overlaps("w1", "w2") >= least_overlap).select("c1", "c2"))


def cross_split_pairs(pairs: DataFrame, train: str = "train", held_out: tuple[str, ...] = ("val", "test"), least_words: int = 30, least_overlap: float = 0.5) -> DataFrame:
    """(pair_id_a, pair_id_b, same_query, near_passage): every record in train with one held out that has a near-same passage or the same query.

    Passages of at least `least_words` words are near-same if they share `least_overlap` of the three-word sequences of the one that has more
    of them. Equal passages form a class, compared once and expanded at the end; candidates share several of the rarest shingles of either,
    which every such pair does, so phrases that stand everywhere seldom make candidates; each is verified exactly. Queries are the same if equal without case, accents, compatibility forms and all but letters and digits; queries with nothing left equal none.

    Null passages or queries match nothing, records of another or no split take no part, a pair_id delivered twice counts once and null ids are
    dropped. Empty tables give an empty result; further columns are ignored.
    """
    side = F.when(F.col("split_name") == train, "t").when(F.col("split_name").isin(*held_out), "h")
    records = pairs.where("pair_id is not null").select("pair_id", side.alias("side"), "passage", "query").where("side is not null")
    # equal word sequences have equal keys; what is kept of the records are these, the words are shuffled once, combined by key before
    keyed = cut(word_keys(records, least_words))
    classes = cut(word_classes(records, least_words).groupBy("key").agg(F.min("pair_id").alias("class"), F.first("words").alias("words"), F.max(F.col("side") == "t").alias("trained"), F.max(F.col("side") == "h").alias("held")))
    members = cut(keyed.where("key is not null").select("key", "pair_id", "side").join(classes.select("key", "class"), "key").select("class", "pair_id", "side").distinct())
    near = near_classes(classes, least_overlap)
    links = near.union(near.select("c2", "c1")).union(classes.where("trained and held").select("class", "class"))
    trained = members.where("side = 't'").select(F.col("class").alias("c1"), F.col("pair_id").alias("t"))
    kept = members.where("side = 'h'").select(F.col("class").alias("c2"), F.col("pair_id").alias("h"))
    by_passage = links.join(trained, "c1").join(kept, "c2").select("t", "h", F.lit(False).alias("same_query"), F.lit(True).alias("near_passage"))

    asked = keyed.where("q is not null").select("pair_id", "side", "q").distinct()
    by_query = (
        asked.where("side = 't'").select("q", F.col("pair_id").alias("t")).join(asked.where("side = 'h'").select("q", F.col("pair_id").alias("h")), "q")
        .select("t", "h", F.lit(True).alias("same_query"), F.lit(False).alias("near_passage"))
    )
    found = by_passage.union(by_query).groupBy("t", "h").agg(F.max("same_query").alias("same_query"), F.max("near_passage").alias("near_passage"))
    return found.select(F.least("t", "h").alias("pair_id_a"), F.greatest("t", "h").alias("pair_id_b"), "same_query", "near_passage")


def overlap_report(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(split_name, src, n_records, n_pairs): per held-out split and source, how many records overlap with train and in how many pairs."""
    own = pairs.where("pair_id is not null").select("pair_id", "split_name", "src").dropDuplicates(["pair_id"])
    ends = found.select(F.explode(F.array("pair_id_a", "pair_id_b")).alias("pair_id")).groupBy("pair_id").agg(F.count("*").alias("n"))
    return own.join(ends, "pair_id").groupBy("split_name", "src").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"))
