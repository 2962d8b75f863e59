"""Mixing sources to target shares of the tokens: hash-threshold histograms (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.tokens import DEFAULT_FILE, DEFAULT_FOLDER, token_count
from pagewright.session import cut

#: A level of the histogram parts a range of hashes into this many buckets; LEVELS levels resolve 60 bits.
BUCKET_BITS, LEVELS = 12, 5
MAX_SOURCES = 10_000
#: A source is done when less than this part of its budget is left, at the latest after so many rounds.
CLOSE, ROUNDS = 0.001, 12


def source_key(name: Column) -> Column:
    """A source's name whatever its case, blanks and kind of separator; null where nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(key != "", key)


def boundaries(sized: DataFrame, asked: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int, int]]:
    """(end, next, tokens) by source for (first hash, budget): from the first hash on, all documents no larger than the budget with hashes below `end` fit in it together and use these tokens; the document behind does not fit, and the search may go on at `next`.

    Tokens are summed by source and bucket of hashes; only the bucket in which the budget ends is refined, until it holds one document.
    """
    spark, width = sized.sparkSession, 1 << BUCKET_BITS
    low, used, behind, alive, open_ = dict.fromkeys(asked, 0), dict.fromkeys(asked, 0), {}, set(asked), set()
    for level in range(LEVELS):
        shift = BUCKET_BITS * (LEVELS - 1 - level)
        if not alive:
            break
        bounds = F.broadcast(spark.createDataFrame([(s, low[s], asked[s][0], asked[s][1], asked[s][1] - used[s]) for s in sorted(alive)], "source string, low long, first long, cap long, room long"))
        inside = sized.join(bounds, "source").where((F.col("hash") >= F.greatest("low", "first")) & (F.col("tokens") <= F.col("cap"))).withColumn("bucket", F.shiftright(F.col("hash") - F.col("low"), shift)).where(F.col("bucket") < width)
        sums = inside.groupBy("source", "bucket", "room").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
        # running sums over the at most 2^12 buckets of a source; of these one row a source comes back: the bucket in which its room ends
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        ends = F.when(F.col("upto") > F.col("room"), F.struct("bucket", "docs"))
        for r in running.groupBy("source").agg(F.min(ends).alias("end"), F.sum(F.when(ends.isNull(), F.col("n"))).alias("n")).collect():
            used[r.source] += r.n or 0
            if r.end is None:
                continue
            low[r.source] += r.end.bucket << shift
            if r.end.docs == 1:  # the document that does not fit: go on behind its bucket
                behind[r.source] = low[r.source] + (1 << shift)
                alive.discard(r.source)
            open_.add(r.source)
        for s in sorted(alive - open_):
            low[s] += width << shift
        alive &= open_
        open_.clear()
    return {s: (max(low[s], asked[s][0]), max(behind.get(s, low[s] + 1), asked[s][0]), used[s]) for s in asked}


def draw(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_folder: str = DEFAULT_FOLDER, tokenizer_file: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). drawn: (key, source, repeats, tokens), repeats >= 1; shares: (source, target_share, budget, drawn_tokens, share, max_repeats, available_tokens).

    Sources without tokens cannot give their share; the others' shares are scaled up in proportion, and `target_share` in `shares` stays the
    wanted one. The budget of a source is its scaled share of `total_tokens`, by default of the largest total that no source's repeats
    forbid. A source repeats all its documents as often as its budget holds them whole, and once more those whose hash lies under a threshold,
    found by summing tokens by source and hash bucket and refining only the bucket in which the budget ends. So nothing is sorted, one
    row a source reaches the driver a level. Documents that do not fit in what is left are passed over, so a source falls short of its budget
    by little where it has small documents.

    `targets` (source, target_share, max_repeats) may have at most MAX_SOURCES rows; sources are matched whatever their spelling, shares of the
    same source add up, repeats count from 1. Rows with a null or a share <= 0 are ignored, so are documents of other or null sources, without
    tokens or with a null key; a key delivered twice counts once. Nothing drawn gives empty results.
    """
    spark = documents.sparkSession
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(r.source,) for r in rows], "source string")
    picked = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), source_key(F.col("source")).alias("source"), F.col(text).alias("text")).join(F.broadcast(names), "source", "left_semi")
    # 60 bits of the hash, so that levels of 12 bits divide it evenly
    sized = picked.select("key", "source", token_count(F.col("text"), tokenizer_folder, tokenizer_file).alias("tokens"))
    sized = cut(sized.where("tokens > 0").groupBy("key").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")).withColumn("hash", F.shiftrightunsigned(F.xxhash64("key"), 4)))

    available = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    present = [r for r in rows if available.get(r.source)]
    scale = sum(r.share for r in present)
    largest = min((available[r.source] * r.repeats * scale / r.share for r in present), default=0)
    total = largest if total_tokens is None else min(float(total_tokens), largest)
    budgets = {r.source: total * r.share / scale for r in present}
    whole = {r.source: min(int(budgets[r.source] // available[r.source]), r.repeats) for r in present}
    left = {r.source: 0.0 if whole[r.source] >= r.repeats else budgets[r.source] - whole[r.source] * available[r.source] for r in present}

    # A source takes documents in the order of their hashes up to where its budget ends; the document there does not fit, so the next round goes on
    # behind it with documents no larger than what is left, until that is next to nothing.
    ranges: dict[str, list[tuple[int, int, int]]] = {s: [] for s in left}
    start = dict.fromkeys(left, 0)
    for _ in range(ROUNDS):
        waiting = {s: int(left[s]) for s in left if left[s] >= 1 and left[s] > CLOSE * budgets[s] and start[s] < 1 << (BUCKET_BITS * LEVELS)}
        if not waiting:
            break
        ends = boundaries(sized, {s: (start[s], cap) for s, cap in waiting.items()})
        for s, (end, following, used) in ends.items():
            if end > start[s]:
                ranges[s].append((start[s], end, waiting[s]))
            left[s] -= used
            start[s] = following
    plan = spark.createDataFrame([(r.source, whole[r.source], ranges[r.source]) for r in present], "source string, whole int, ranges array<struct<lo:long,hi:long,cap:long>>")
    extra = F.exists("ranges", lambda r: (F.col("hash") >= r["lo"]) & (F.col("hash") < r["hi"]) & (F.col("tokens") <= r["cap"])).cast("int")
    drawn = sized.join(F.broadcast(plan), "source").select("key", "source", (F.col("whole") + extra).alias("repeats"), "tokens").where("repeats > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("drawn_tokens"))
    meant = spark.createDataFrame([(r.source, float(r.share), float(budgets.get(r.source, 0.0)), int(r.repeats), int(available.get(r.source, 0))) for r in rows], T.StructType.fromDDL("source string, target_share double, budget double, max_repeats int, available_tokens long"))
    joined = meant.join(got, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy())  # of one row a source
    shares = joined.withColumn("_all", all_tokens).select("source", "target_share", "budget", "drawn_tokens", F.coalesce(F.try_divide("drawn_tokens", "_all"), F.lit(0.0)).alias("share"), "max_repeats", "available_tokens")
    return drawn.withColumnRenamed("key", key), shares
