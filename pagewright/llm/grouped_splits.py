"""Splits that keep related records together: components of documents, then grouped iterative stratification (problem 1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import cut

#: Sorts behind every document in byte order, so the smallest node of a component is a document.
AUTHOR_MARK = "\U0010ffff"
CHUNK = r"(?is)^\s*(.*?)\s*:+\s*sec\w*\s*:+.*$"

# An entry made of such words alone names nobody; words that are no part of a name.
NOBODY = frozenset("unknown various anonymous anon editorial staff team board editor editors writer writers author authors no not n a na none null nan given known available listed misc tba tbd multiple several others other et al the collective unbekannt verfasser anonyme inconnu anonimo desconocido sconosciuto autor auteur autore".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir by von phd md jr sr ed eds editor edited written".split())


def document_key(name: Column) -> Column:
    """The spelling-free form of a document's name: file name without folder and suffix, lower case, runs of other characters than letters and digits as one underscore."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^.*[/\\]", ""), r"\.(?:pdf|txt|docx?|html?|epub)$", "")
    key = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(key != "", key)


def people_of(author: str | None) -> list[str]:
    """The persons an author field names, each in one form whatever the order, case, accents, titles and spacing."""
    if not author:
        return []
    out = set()
    for part in re.split(r"[;&/|+]|\b(?:and|und|et|with)\b", author, flags=re.I):
        plain = "".join(c for c in unicodedata.normalize("NFKD", part.casefold()) if not unicodedata.combining(c))
        words = [w for w in re.findall(r"[^\W\d_]+", plain) if w not in TITLES]
        if any(len(w) > 1 for w in words) and not NOBODY.issuperset(words):
            out.add(" ".join(sorted(words)))
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def people(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(people_of)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge with another node; the root is the smallest node of the component in byte order.

    Alternating large and small stars: each round links a node's neighbours to the smallest of them, halving the depth of what is left. The
    links stay distributed, minima are combined before the shuffle, and each round is written to the checkpoint folder. `edges` has columns
    a and b; nulls, loops and repeated edges are ignored.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours greater than a point to the smallest node around a
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        links = cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def record_groups(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(pair_id, group_doc): the smallest doc_id of the group of documents that a record belongs to.

    A record belongs to the document its doc_id names and to the one its chunk_id names, however spelled. Documents are in one group if a
    record belongs to both, if they share an author, or over further documents. Names that match no document tie nothing; a record with no
    document at all gets a null group_doc. Every pair_id comes out once; null pair_ids are dropped. Catalogue rows whose doc_ids differ in
    spelling only count as one document. Empty tables give an empty result or null groups; further columns are ignored.
    """
    documents = catalog.select(document_key(F.col("doc_id")).alias("key"), "doc_id", "author").where("key is not null")
    named = documents.groupBy("key").agg(F.min("doc_id").alias("node"))
    records = pairs.where("pair_id is not null").select("pair_id", document_key(F.col("doc_id")).alias("dk"), document_key(F.regexp_extract(F.col("chunk_id"), CHUNK, 1)).alias("ck")).dropDuplicates(["pair_id"])

    crossing = records.where("dk <> ck").select("dk", "ck").distinct()
    by_record = crossing.join(named.select(F.col("key").alias("dk"), F.col("node").alias("a")), "dk").join(named.select(F.col("key").alias("ck"), F.col("node").alias("b")), "ck").select("a", "b")
    by_author = documents.where("author is not null").select("key", F.explode(people("author")).alias("person")).join(named, "key").select(F.concat(F.lit(AUTHOR_MARK), "person").alias("a"), F.col("node").alias("b"))
    roots = components(by_record.union(by_author))

    groups = named.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("group_doc"))
    by_doc = groups.select(F.col("key").alias("dk"), F.col("group_doc").alias("g1"))
    by_chunk = groups.select(F.col("key").alias("ck"), F.col("group_doc").alias("g2"))
    return records.join(by_doc, "dk", "left").join(by_chunk, "ck", "left").select("pair_id", F.coalesce("g1", "g2").alias("group_doc"))


def place(units: list[tuple[str, int, int]], need: list[float], target: list[float], overall: list[float], overall_target: list[float]) -> tuple[dict[str, int], list[float]]:
    """({group: split number}, what each split still needs of the label) for (group, records of the label, records): the largest first, each where most is lacking.

    What is lacking is measured behind the placement and relative to the split's target, of the label and of all records together.
    """
    need, overall, out = list(need), list(overall), {}
    for group, n, size in sorted(units, key=lambda x: (-x[1], -x[2], x[0])):
        best = max(range(len(need)), key=lambda i: ((need[i] - n) / target[i] + (overall[i] - size) / overall_target[i], -i))
        out[group] = best
        need[best] -= n
        overall[best] -= size
    return out, need


def spread(rows: DataFrame, by: str, weight: str) -> DataFrame:
    """`rows` (with _g) with `before`, the weight of the rows of the same `by` that stand before in the order of their hashes. Only sums by 4096 ranges of hashes are ordered; within a range it is taken in proportion."""
    hashed = rows.withColumn("_h", F.xxhash64("_g", F.lit(5))).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int")).withColumn("_part", F.shiftrightunsigned(F.shiftleft("_h", 12), 12) / F.lit(float(1 << 52)))
    sums = hashed.groupBy(by, "_range").agg(F.sum(weight).alias("_mass"))
    running = sums.withColumn("_before", F.sum("_mass").over(Window.partitionBy(by).orderBy("_range")) - F.col("_mass"))
    return hashed.join(running, [by, "_range"]).withColumn("before", F.col("_before") + F.col("_part") * F.col("_mass")).drop("_h", "_range", "_part", "_mass", "_before")


def grouped_splits(records: DataFrame, targets: DataFrame, key: str = "pair_id", group: str = "group_doc", label: str = "src", heavy: int = 64, close: float = 0.001) -> DataFrame:
    """(key, split_name) of every record, all records of a group in one split, near the shares of `targets` (split_name, target_share) over all records and by label.

    Groups are ranged under the label with the fewest outstanding records that they hold, and the rarest labels go first: those within a factor
    of two of each other side by side, so that there are at most as many passes as the number of records has bits, whatever the number of
    labels. Under a label, groups that hold at least 1/`heavy` of what is ranged there are placed one by one, the largest first, where most is
    lacking; the others go each by its place in the order of hashes, so that every split gets what it still needs. In the end whole groups
    are moved from splits with too much to those with too little until none is off by more than `close` of all records or no move helps.

    Counts by group, label and split stay distributed; a task holds at most `heavy` groups of a label, the driver one number a split. A null group
    is a group of its own per record, a null label a label; null keys are dropped, a key delivered twice counts once; empty records give an
    empty result, empty targets or more than 1000 a ValueError. A group larger than a split's share goes where it does least harm.
    """
    wanted = [(r[0], float(r[1])) for r in targets.select("split_name", "target_share").where("split_name is not null and target_share > 0").orderBy("split_name").limit(1001).collect()]
    if not wanted or len(wanted) > 1000:
        raise ValueError("targets must name between 1 and 1000 splits")
    shares = [x / sum(x for _, x in wanted) for _, x in wanted]
    spark = records.sparkSession
    base = records.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key), F.coalesce(F.concat(F.lit("g"), F.col(group)), F.concat(F.lit("r"), F.col(key).cast("string"))).alias("_g"), F.coalesce(F.col(label), F.lit("")).alias("_label"))
    counts = cut(base.groupBy("_g", "_label").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("_g").agg(F.sum("n").alias("size"))
    totals = counts.groupBy("_label").agg(F.sum("n").alias("total"))
    n_records = totals.agg(F.sum("total")).first()[0] or 0
    aims = [n_records * x for x in shares]

    def held(placed: DataFrame) -> list[int]:
        got = {r.split: r.n for r in placed.groupBy("split").agg(F.sum("size").alias("n")).collect()}
        return [got.get(i, 0) for i in range(len(shares))]

    def of_stratum(overall: list[float]):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            first = rows[rows._g.isna()].iloc[0]
            given = {int(g["split"]): float(g["n"]) for g in first.given} if first.given is not None else {}
            target = [float(first.total) * x for x in shares]
            units = rows[rows._g.notna()]
            chosen, left = place(list(zip(units["_g"], units["n"].astype(int), units["size"].astype(int))), [t - given.get(i, 0.0) for i, t in enumerate(target)], target, overall, aims)
            lacking = np.maximum(left, 0)
            ends = np.cumsum(lacking / lacking.sum() if lacking.sum() else shares)
            return pd.DataFrame({"stratum": first.stratum, "_g": [*chosen, None], "split": [*chosen.values(), -1], "ends": [*[None] * len(chosen), ends.tolist()]})

        return run

    placed = spark.createDataFrame([], "_g string, split int, size long")
    waiting, bits = counts, 0
    while True:
        outstanding = waiting.groupBy("_label").agg(F.sum("n").alias("open"))
        least = outstanding.agg(F.min("open")).first()[0]
        if least is None:
            break
        bits = max(bits + 1, int(least).bit_length())
        now = outstanding.where(F.col("open") < F.lit(1 << bits))
        ranged = waiting.join(now, "_label").groupBy("_g").agg(F.min_by(F.struct("_label", "n"), F.struct("open", "_label")).alias("s")).select("_g", F.col("s._label").alias("stratum"), "s.n").join(sizes, "_g")
        ranged = cut(ranged)
        given = counts.join(placed.select("_g", "split"), "_g").groupBy("_label", "split").agg(F.sum("n").alias("n")).groupBy("_label").agg(F.collect_list(F.struct("split", "n")).alias("given"))
        strata = ranged.groupBy("stratum").agg(F.sum("n").alias("mass")).join(totals.withColumnRenamed("_label", "stratum"), "stratum").join(given.withColumnRenamed("_label", "stratum"), "stratum", "left")
        judged = ranged.join(strata.select("stratum", "mass"), "stratum")
        big = judged.where(F.col("n") * heavy >= F.col("mass")).select("stratum", "_g", "n", "size", F.lit(None).cast("long").alias("total"), F.lit(None).cast("array<struct<split:int,n:long>>").alias("given"))
        heads = strata.select("stratum", F.lit(None).cast("string").alias("_g"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), "total", "given")
        lacking = [a - h for a, h in zip(aims, held(placed))]
        one_by_one = cut(big.union(heads).groupBy("stratum").applyInPandas(of_stratum(lacking), "stratum string, _g string, split int, ends array<double>"))
        small = spread(judged.where(F.col("n") * heavy < F.col("mass")).drop("mass"), "stratum", "n")
        of_small = small.groupBy("stratum").agg(F.sum("n").alias("small_mass")).join(one_by_one.where("split < 0").select("stratum", "ends"), "stratum")
        at = F.least(F.size(F.filter("ends", lambda e: e <= F.col("before") / F.col("small_mass"))), F.lit(len(shares) - 1))
        by_place = small.join(of_small, "stratum").select("_g", at.cast("int").alias("split"), "size")
        new = cut(one_by_one.where("split >= 0").select("_g", "split").join(ranged.select("_g", "size"), "_g").select("_g", "split", "size").union(by_place))
        placed, waiting = placed.union(new), cut(waiting.join(new.select("_g"), "_g", "left_anti"))

    placed, have = cut(placed), None
    for _ in range(8):
        now = held(placed)
        if have is not None and sum(abs(x - a) for x, a in zip(now, aims)) >= sum(abs(x - a) for x, a in zip(have, aims)):
            placed = before  # the last moves did not help
            break
        have, before = now, placed
        over = [x - a for x, a in zip(have, aims)]
        if max(map(abs, over), default=0) <= close * n_records:
            break
        # surpluses and lacks laid end to end: what is moved from a place of the one goes to the split at that place of the other
        givers, takers = [(i, x) for i, x in enumerate(over) if x > 0], [(i, -x) for i, x in enumerate(over) if x < 0]
        starts = np.cumsum([0.0, *(x for _, x in givers)])
        ends = np.cumsum([x for _, x in takers])
        plan = spark.createDataFrame([(i, float(x), float(a)) for (i, x), a in zip(givers, starts)], "split int, surplus double, start double")
        candidates = placed.join(F.broadcast(plan), "split").where(F.col("size") <= F.greatest(F.lit(1.0), F.col("surplus") / 4))
        moved = spread(candidates, "split", "size").where(F.col("before") + F.col("size") / 2 < F.col("surplus"))
        index = F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= F.col("start") + F.col("before"))), F.lit(len(takers) - 1))
        goal = F.element_at(F.array(*[F.lit(i) for i, _ in takers]), index + 1)
        placed = cut(placed.join(moved.select("_g", goal.cast("int").alias("goal")), "_g", "left").select("_g", F.coalesce("goal", "split").alias("split"), "size"))
    names = F.element_at(F.array(*[F.lit(name) for name, _ in wanted]), F.col("split") + 1)
    return base.join(placed.select("_g", names.alias("split_name")), "_g").select(key, "split_name")
