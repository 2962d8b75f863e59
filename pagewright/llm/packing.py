"""Filling fixed-capacity containers with documents: sum-of-squares online packing (problem 7)."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import DEFAULT_FILE, DEFAULT_FOLDER, token_count
from pagewright.session import cut

#: Tokens that one packing task takes on at about; a stream of this length leaves few windows open against those it closes.
STREAM_TOKENS = 4_000_000


class Packer:
    """Windows of one capacity. `level` counts the partly filled windows by fill; an item goes to the fill that makes the sum of squared counts least, or into a new window."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of 1 to `capacity` tokens. Ties take the fullest window."""
        c, level = self.capacity, self.level
        # change of the sum of squares when a window goes from fill f to f + size; full and empty windows do not count
        top = c - size
        change = np.full(top + 1, np.inf)
        f = np.flatnonzero(level[1 : top + 1]) + 1
        if len(f):
            gain = -2.0 * level[f] + 1
            then = f + size
            gain += np.where(then < c, 2.0 * level[then] + 1, 0.0)
            change[f] = gain
        change[0] = 2.0 * level[size] + 1 if size < c else 0.0
        at = top - int(np.argmin(change[::-1]))
        if at == 0:
            window = self.n
            self.n += 1
        else:
            window = self.open[at].pop()
            level[at] -= 1
        if at + size < c:
            level[at + size] += 1
            self.open[at + size].append(window)
        return window, at


def pieces_of(tokens: int, capacity: int) -> list[int]:
    """A document in whole windows and a rest where it exceeds the capacity alone, else uncut."""
    whole, rest = divmod(tokens, capacity)
    return [tokens] if tokens <= capacity else [capacity] * whole + ([rest] if rest else [])


def pack(documents: DataFrame, capacities: DataFrame, tokenizer_folder: str = DEFAULT_FOLDER, tokenizer_file: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text", stream_tokens: int = STREAM_TOKENS) -> DataFrame:
    """(container, stream, window, key, piece, start, tokens, token_offset): where each document, or each piece of it, lies in windows of each capacity.

    Documents are spread by hash over streams of about `stream_tokens` tokens; each stream is packed online in hash order, so a task holds the
    lengths of one stream whatever the corpus. Lengths that recur, or a text repeated in a third of the rows, spread over all streams. Documents
    without tokens (null, empty) lie in no window. A document longer than the capacity is cut into full windows and a rest; `piece` counts from 0,
    `token_offset` is where the piece begins in the document. `capacities` (container, capacity_tokens) may have at most 1000 rows; rows with a
    null or a capacity below 1 are ignored. A key delivered twice counts once, null keys are dropped. Empty tables give an empty result.
    """
    wanted = [(r[0], int(r[1])) for r in capacities.select("container", "capacity_tokens").where("container is not null and capacity_tokens >= 1").distinct().orderBy("container").limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1000 containers")
    sized = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), token_count(documents[text], tokenizer_folder, tokenizer_file).alias("tokens"))
    sized = cut(sized.where("tokens > 0").groupBy("key").agg(F.max("tokens").alias("tokens")))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    n_streams = max(1, round(total / stream_tokens))
    each = F.array(*[F.struct(F.lit(name).alias("container"), F.lit(capacity).alias("capacity")) for name, capacity in wanted or [("", 1)]])
    jobs = sized.where(F.lit(bool(wanted))).select("key", "tokens", F.xxhash64("key", F.lit(17)).alias("order"), F.pmod(F.xxhash64("key"), F.lit(n_streams)).cast("int").alias("stream"), F.explode(each).alias("c")).select("key", "tokens", "order", "stream", "c.*")
    kind = dict(sized.dtypes)["key"]
    schema = f"container string, stream int, window long, key {kind}, piece int, start int, tokens int, token_offset long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "key"])
        capacity = int(group.capacity.iloc[0])
        packer, out = Packer(capacity), []
        for name, tokens in zip(group.key, group.tokens):
            at = 0
            for i, size in enumerate(pieces_of(int(tokens), capacity)):
                window, start = packer.place(size)
                out.append((window, name, i, start, size, at))
                at += size
        frame = pd.DataFrame(out, columns=["window", "key", "piece", "start", "tokens", "token_offset"])
        frame.insert(0, "stream", group.stream.iloc[0])
        frame.insert(0, "container", group.container.iloc[0])
        return frame

    return jobs.groupBy("container", "capacity", "stream").applyInPandas(run, schema).withColumnRenamed("key", key)


def windows(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, stream, window, n_items, tokens, fill): every window with its fill, 0 to 1."""
    return (
        packed.groupBy("container", "stream", "window")
        .agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))
        .join(F.broadcast(capacities.select("container", "capacity_tokens").where("container is not null and capacity_tokens >= 1").distinct().limit(1000)), "container")
        .select("container", "stream", "window", "n_items", "tokens", (F.col("tokens") / F.col("capacity_tokens")).alias("fill"))
    )


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, n_windows, n_items, tokens, fill): one row a container."""
    return windows(packed, capacities).groupBy("container").agg(F.count("*").alias("n_windows"), F.sum("n_items").alias("n_items"), F.sum("tokens").alias("tokens"), F.avg("fill").alias("fill"))
