"""Contrastive loss as a relation, and a low-rank adapter over frozen vectors trained with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import words_of
from pagewright.functions.vectors import dot
from pagewright.session import cut


def batch_numbers(pairs: DataFrame, batch_size: int, pair_id: str = "pair_id", seed: int | None = None) -> DataFrame:
    """Adds `batch`: pairs in the order of pair_id, or of a seeded hash, `batch_size` at a time.

    The position is a count of earlier prefixes of the order plus a rank within one. Prefixes are counted in steps, each within the one before,
    so a task orders the pairs of one prefix, or the prefixes of one that is shorter, and none orders all.
    """
    order = F.md5(F.concat(F.col(pair_id).cast("string"), F.lit(f"|{seed}"))) if seed is not None else F.lpad(F.col(pair_id).cast("string"), 20, "0")
    lengths = (6, 4, 2, 0) if seed is not None else (17, 14, 11, 8, 0)
    keyed = pairs.withColumn("_o", order).withColumn("_p", F.substring("_o", 1, lengths[0]))
    counts = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.lit(0).cast("long").alias("_b"))
    for long, short in zip(lengths, lengths[1:]):
        level = counts.groupBy(F.substring("_p", 1, long).alias("_q")).agg(F.sum("_n").alias("_n"))
        earlier = Window.partitionBy(F.substring("_q", 1, short)).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        level = level.select("_q", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_more"))
        before = before.withColumn("_q", F.substring("_p", 1, long)).join(level, "_q").select("_p", (F.col("_b") + F.col("_more")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
    return keyed.join(before, "_p").withColumn("batch", F.floor((F.col("_b") + rank) / batch_size)).drop("_o", "_p", "_b")


def batch_tokens(pairs: DataFrame, batch: str = "batch", most: int = 128, columns: tuple[str, ...] = ("anchor", "positive"), pad: str = "") -> DataFrame:
    """(batch, pair_id, and for each of `columns` its tokens and mask): white-space tokens cut at `most`, padded to the longest of the batch, mask 1 for what is not padding."""
    cut_to = {c: F.slice(words_of(F.coalesce(F.col(c), F.lit(""))), 1, most) for c in columns}
    cut_up = pairs.select(batch, "pair_id", *[x.alias(c) for c, x in cut_to.items()])
    widths = cut_up.groupBy(batch).agg(*[F.max(F.size(c)).alias(f"_{c}") for c in columns])
    filled = cut_up.join(widths, batch)
    out = [e for c in columns for e in (F.concat(c, F.array_repeat(F.lit(pad), F.col(f"_{c}") - F.size(c))).alias(f"{c}_tokens"), F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), F.col(f"_{c}") - F.size(c))).alias(f"{c}_mask"))]
    return filled.select(batch, "pair_id", *out)


def contrastive_losses(pairs: DataFrame, temperature: float = 1.0, batch: str = "batch") -> DataFrame:
    """(batch, loss): within each batch, the mean cross-entropy of each anchor's own positive against the batch's other positives.

    A batch is bounded by the batch size, so its pairs may meet. `pairs` has pair_id, anchor and positive vectors and the batch.
    """
    a = pairs.select(batch, F.col("pair_id").alias("i"), F.col("anchor").alias("a"))
    b = pairs.select(batch, F.col("pair_id").alias("j"), F.col("positive").alias("b"))
    z = a.join(b, batch).select(batch, "i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("z"))
    top = z.withColumn("m", F.max("z").over(Window.partitionBy(batch, "i")))
    per = top.groupBy(batch, "i").agg((F.max("m") + F.log(F.sum(F.exp(F.col("z") - F.col("m")))) - F.max(F.when(F.col("i") == F.col("j"), F.col("z")))).alias("loss"))
    return per.groupBy(batch).agg(F.avg("loss").alias("loss"))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """One row: the unweighted mean of the batches' losses, 0 without any."""
    return losses.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("epoch_loss"))


#: The sides of a pair whose vectors an adapter can act on.
SIDES = ("anchor", "positive")


@dataclass(frozen=True)
class AdapterConfig:
    """`lora_dropout` is the share of inputs of the adapter that a training step leaves out; `target_modules` are the sides it acts on."""

    r: int = 16
    lora_alpha: int = 32
    lora_dropout: float = 0.1
    learning_rate: float = 2e-4
    epochs: int = 10
    batch_size: int = 4
    temperature: float = 1.0
    seed: int = 42
    target_modules: tuple[str, ...] = SIDES

    def __post_init__(self) -> None:
        if self.r < 1 or not 0 <= self.lora_dropout < 1 or not set(self.target_modules) <= set(SIDES) or not self.target_modules:
            raise ValueError("adapter: rank from 1, dropout from 0 to below 1, sides among " + ", ".join(SIDES))

    def to_dict(self) -> dict:
        return asdict(self)


def scaled_rate(rate: float, batch_size: int, base_batch: int) -> float:
    return rate * batch_size / base_batch


def _forward(x: np.ndarray, down: np.ndarray, up: np.ndarray, scale: float, kept: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = (x * kept) @ down.T
    v = x + scale * h @ up.T
    n = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v / n, n, h


def _backward(g: np.ndarray, y: np.ndarray, n: np.ndarray, h: np.ndarray, x: np.ndarray, up: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    gv = (g - y * (g * y).sum(1, keepdims=True)) / n
    return scale * (gv @ up).T @ x, scale * gv.T @ h


def batch_gradient(a: np.ndarray, p: np.ndarray, down: np.ndarray, up: np.ndarray, scale: float, temperature: float, masks: tuple = (1.0, 1.0), sides: tuple[str, ...] = SIDES) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradients of the two adapter matrices for one batch of anchors and positives; `masks` multiply the adapter's inputs, a side not in `sides` stays as it is."""
    on = [float(s in sides) for s in SIDES]
    ya, na, ha = _forward(a, down, up, scale * on[0], masks[0])
    yp, n_p, hp = _forward(p, down, up, scale * on[1], masks[1])
    z = ya @ yp.T / temperature
    z -= z.max(1, keepdims=True)
    s = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(np.diag(s), 1e-300)).mean())
    gz = (s - np.eye(len(a))) / len(a) / temperature
    d1, u1 = _backward(gz @ yp, ya, na, ha, a * masks[0], up, scale * on[0])
    d2, u2 = _backward(gz.T @ ya, yp, n_p, hp, p * masks[1], up, scale * on[1])
    return loss, d1 + d2, u1 + u2


def apply_adapter(df: DataFrame, matrices: dict[str, np.ndarray], config: AdapterConfig | dict, vector: str = "embedding", into: str = "adapted") -> DataFrame:
    """Adds the adapted vectors, length one; a null vector stays null. The two matrices go to the tasks, their size being that of the adapter."""
    settings = config if isinstance(config, dict) else config.to_dict()
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(matrices["down"], float), np.asarray(matrices["up"], float)))
    scale = settings["lora_alpha"] / settings["r"]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        down, up = shared.value
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            there = np.flatnonzero(batch.notna())
            if len(there):
                y = _forward(np.stack(batch.iloc[there]).astype(float), down, up, scale)[0]
                for i, v in zip(there, y):
                    out.iat[i] = v
            yield out

    return df.withColumn(into, run(F.col(vector).cast("array<double>")))


def train_adapter(pairs: DataFrame, config: AdapterConfig = AdapterConfig(), steps_per_epoch: int | None = 8, sequential: bool = False) -> tuple[list[float], dict[str, np.ndarray]]:
    """(loss by epoch, {down, up}): v' = normalised v + (alpha / r) up down v, the vectors themselves stay frozen.

    Each step takes a slice of the batches, sums their gradients where the data lie, and moves the matrices on the driver by AdamW; only the
    two matrices travel. Batches are drawn by seeded hash and steps take every so many-th of them; `sequential` keeps the order of pair_id in
    both, the last batch may be short. Without `steps_per_epoch` every batch is a step, which is a job each: for small sets.
    """
    dim = len(pairs.select("anchor").first()[0])
    rng = np.random.default_rng(config.seed)
    down, up = rng.standard_normal((config.r, dim)) / np.sqrt(dim), np.zeros((dim, config.r))
    scale = config.lora_alpha / config.r
    numbered = cut(batch_numbers(pairs, config.batch_size, seed=None if sequential else config.seed).select("batch", "pair_id", "anchor", "positive"))
    all_batches = (numbered.agg(F.max("batch")).first()[0] or 0) + 1
    steps_per_epoch = min(steps_per_epoch or all_batches, all_batches)
    step_of = F.floor(F.col("batch") * steps_per_epoch / all_batches) if sequential else F.pmod("batch", F.lit(steps_per_epoch))
    data = numbered.withColumn("step", step_of.cast("int"))
    m = [np.zeros_like(down), np.zeros_like(up)]
    v = [np.zeros_like(down), np.zeros_like(up)]
    t, losses = 0, []
    for epoch in range(config.epochs):
        total, n_batches = 0.0, 0
        for step in range(steps_per_epoch):
            d, u = down.copy(), up.copy()

            def gradient(frames: Iterator[pd.DataFrame], d=d, u=u, epoch=epoch) -> Iterator[pd.DataFrame]:
                loss, gd, gu, n = 0.0, np.zeros_like(d), np.zeros_like(u), 0

                def batches() -> Iterator[pd.DataFrame]:
                    # a batch may go on in the next frame
                    rest = None
                    for frame in frames:
                        for number, own in frame.groupby("batch", sort=True):
                            if rest is not None and rest.batch.iat[0] == number:
                                own = pd.concat([rest, own])
                            elif rest is not None:
                                yield rest
                            rest = own
                    if rest is not None:
                        yield rest

                for own in batches():
                    a, p = np.stack(own.anchor).astype(float), np.stack(own.positive).astype(float)
                    draw = np.random.default_rng([config.seed, epoch, int(own.batch.iat[0])])
                    masks = tuple((draw.random(x.shape) >= config.lora_dropout) / (1 - config.lora_dropout) for x in (a, p)) if config.lora_dropout else (1.0, 1.0)
                    one, x, y = batch_gradient(a, p, d, u, scale, config.temperature, masks, config.target_modules)
                    loss, gd, gu, n = loss + one, gd + x, gu + y, n + 1
                yield pd.DataFrame({"loss": [loss], "n": [n], "down": [gd.ravel()], "up": [gu.ravel()]})

            parts = data.where(F.col("step") == step).repartition("batch").sortWithinPartitions("batch", "pair_id").mapInPandas(gradient, "loss double, n long, down array<double>, up array<double>").collect()
            n = sum(r.n for r in parts)
            if not n:
                continue
            grads = [sum(np.array(r.down) for r in parts).reshape(down.shape) / n, sum(np.array(r.up) for r in parts).reshape(up.shape) / n]
            total, n_batches, t = total + sum(r.loss for r in parts), n_batches + n, t + 1
            for i, (w, g) in enumerate(zip((down, up), grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w -= config.learning_rate * ((m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) + 0.01 * w)
        losses.append(total / n_batches if n_batches else 0.0)
    return losses, {"down": down, "up": up}
