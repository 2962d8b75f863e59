"""Most similar vectors for every vector: stable projections under a kd-tree with a chi-square stopping test (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut

#: Projected dimensions of the search within a cell, admitted chance that its stopping test misses a neighbour at the bound, and rows per leaf.
DIMENSIONS, MISS, LEAF_ROWS = 16, 0.05, 192
#: Rows of a cell at about; rows or queries that a task takes on at most; rows of the sample that places the cuts, and cuts it places by node.
CELL_ROWS, TASK_ROWS, SAMPLE_ROWS, SAMPLE_LEVELS = 3_000, 24_000, 16_384, 10
#: Trees over which near pairs are sought, and the chance per tree to miss one at the bound; all of them miss it with a chance of TREE_MISS ** TREES at most.
TREES, TREE_MISS = 4, 0.35
SEED = 77


def chi_square_quantile(p: float, m: int) -> float:
    """By the cube-root approximation of Wilson and Hilferty; its error is far below that of the miss chance it serves."""
    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * (2 / (9 * m)) ** 0.5) ** 3


def projection(dim: int, m: int, seed: int = 0) -> np.ndarray:
    """Independent normal (2-stable) directions: a squared projected distance divided by the squared distance is chi-square with m degrees."""
    return np.random.default_rng([SEED, seed]).standard_normal((dim, m)).astype(np.float32)


class Tree:
    """A kd-tree over projected points, kept as an order of the rows and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        parts, leaves = [np.arange(len(points))], []
        while parts:
            rows = parts.pop()
            box = points[rows]
            axis = int(np.argmax(box.max(0) - box.min(0))) if len(rows) else 0
            if len(rows) <= leaf_rows:
                leaves.append(rows)
                continue
            half = len(rows) // 2
            order = np.argpartition(box[:, axis], half)
            parts += [rows[order[half:]], rows[order[:half]]]
        self.order = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[x].min(0) for x in leaves], np.float32)
        self.high = np.array([points[x].max(0) for x in leaves], np.float32)


def box_distances(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared least distances from one box to each of many."""
    gap = np.maximum(0, np.maximum(lows - high, low - highs))
    return (gap * gap).sum(1)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: float, start: np.ndarray | None = None, m: int = DIMENSIONS, miss: float = MISS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row id, cosine) of up to k most similar rows per query with cosine >= `least`, by unit vectors.

    Leaves are taken in the order of their least projected distance; the rows whose projected distance passes the test are verified by their
    cosine; a query's search ends when the next projected distance exceeds the chi-square quantile times its bound: the squared distance of its
    k-th neighbour so far (`start` gives a first one by query), or of `least` if that is nearer. Rows of the query's own id are left out.
    """
    r = projection(queries.shape[1], m, seed)
    p, q = rows @ r, queries @ r
    tree, asked = Tree(p, LEAF_ROWS), Tree(q, LEAF_ROWS)
    p, x, ids = p[tree.order], rows[tree.order], row_ids[tree.order]
    right = np.concatenate([p, np.ones((len(p), 1), np.float32), (p * p).sum(1, keepdims=True)], 1).astype(np.float32)
    factor = chi_square_quantile(1 - miss, m)
    out = []
    for a, b in zip(asked.starts[:-1], asked.starts[1:]):
        own = asked.order[a:b]
        box = q[own]
        far = box_distances(box.min(0), box.max(0), tree.low, tree.high)
        left = np.concatenate([-2 * box, (box * box).sum(1, keepdims=True), np.ones((len(box), 1), np.float32)], 1).astype(np.float32)
        bound = np.full(len(own), max(2 - 2 * least, 1e-6), np.float32)
        if start is not None:
            bound = np.minimum(bound, start[own])
        best = np.full((len(own), k), -np.inf, np.float32)
        best_id = np.full((len(own), k), -1, np.int64)
        order = np.argsort(far, kind="stable")
        at = 0
        while at < len(order):
            reach = factor * bound + 1e-4
            if far[order[at]] > reach.max():
                break
            # a few leaves at a time while bounds still fall, then more
            now = order[at : at + (4 if at < 8 else 24)]
            at += len(now)
            now = now[far[now] <= reach.max()]
            span = np.concatenate([np.arange(tree.starts[j], tree.starts[j + 1]) for j in now])
            near = left @ right[span].T <= reach[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            j = span[j]
            if len(i) > 0.04 * near.size:
                cosine = (queries[own] @ x[span].T)[near]
            else:
                cosine = np.einsum("ij,ij->i", queries[own[i]], x[j], optimize=False)
            good = (cosine >= least - 1e-6) & (ids[j] != query_ids[own[i]])
            i, j, cosine = i[good], ids[j[good]], cosine[good]
            for row in np.unique(i):
                mine = i == row
                value, name = np.concatenate([best[row], cosine[mine]]), np.concatenate([best_id[row], j[mine]])
                top = np.lexsort((name, -value))[:k]
                best[row], best_id[row] = value[top], name[top]
                if best_id[row, -1] >= 0:
                    bound[row] = min(bound[row], max(2 - 2 * float(best[row, -1]), 0.0))
        i, j = np.nonzero(best_id >= 0)
        out.append((own[i], best_id[i, j], best[i, j]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def unit_vectors(vectors: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """(chunk_id, unit) of every usable vector, the unit vector as bytes of float32; unusable are those null, of another length, not finite or all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            kept = np.flatnonzero(np.asarray(column.is_valid()) & np.array([n == dim for n in column.value_lengths().to_pylist()], bool))
            names, lists = batch.column(0).take(pa.array(kept)), column.take(pa.array(kept))
            x = np.asarray(lists.flatten().fill_null(float("nan")), np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(1, initial=0, keepdims=True)
                ok = np.isfinite(x).all(1) & (scale[:, 0] > 0)
                x = x[ok] / scale[ok]
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(ok)), pa.array([v.tobytes() for v in x], pa.binary())], names=["chunk_id", "unit"])

    return vectors.where("chunk_id is not null").select("chunk_id", embedding).mapInArrow(run, "chunk_id string, unit binary")


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution, by the rational approximation of Hastings (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-0.5 * z * z) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


class Cells:
    """The cells of a kd-tree of 2 ** bits leaves. Level d cuts along stable projection d, at the medians of a bounded sample.

    The first SAMPLE_LEVELS levels have a cut by node, so regions that are full of vectors are parted as often as they are full; below, a node
    keeps the medians of its own sample along the further projections, so the tree grows with the data while what is kept of it does not.
    """

    def __init__(self, sample: np.ndarray, bits: int, seed: int):
        self.bits, self.top = bits, min(bits, SAMPLE_LEVELS)
        self.directions = np.random.default_rng(SEED + 1 + seed).standard_normal((sample.shape[1], bits)).astype(np.float32)
        points = sample @ self.directions
        node = np.zeros(len(points), np.int64)
        self.cuts = []
        for d in range(self.top):
            self.cuts.append(medians(points[:, d], node, 1 << d))
            node = 2 * node + (points[:, d] >= self.cuts[d][node])
        self.deep = [medians(points[:, d], node, 1 << self.top) for d in range(self.top, bits)]

    def cut(self, level: int, node: np.ndarray) -> np.ndarray:
        return self.cuts[level][node] if level < self.top else self.deep[level - self.top][node >> (level - self.top)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        points, node = vectors @ self.directions, np.zeros(len(vectors), np.int64)
        for d in range(self.bits):
            node = 2 * node + (points[:, d] >= self.cut(d, node))
        return node

    def reached(self, vectors: np.ndarray, squared: np.ndarray, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector number, cell): the cells in the order of the chance that a neighbour at a squared distance lies in them, until those left hold it with a chance of `miss` or less.

        Along a stable projection the neighbour lies normally distributed about the vector, so the chance of a cell is a product over its cuts.
        Branches with next to no chance are dropped, and vectors for which too little is left then go on with a lower bar.
        """
        points, deviation = (vectors @ self.directions).astype(np.float64), np.sqrt(np.maximum(squared, 1e-12)).astype(np.float64)
        rows, bar, out = np.arange(len(vectors)), 0.02, []
        while len(rows):
            late = []
            for some in np.array_split(rows, int(np.ceil(len(rows) * min(1 / bar, 2.0**self.bits) / 2_000_000))):
                who, node, chance = some, np.zeros(len(some), np.int64), np.ones(len(some))
                for d in range(self.bits):
                    below = normal_cdf((self.cut(d, node) - points[who, d]) / deviation[who])
                    who, node, chance = np.concatenate([who, who]), np.concatenate([2 * node, 2 * node + 1]), np.concatenate([chance * below, chance * (1 - below)])
                    kept = chance >= bar
                    who, node, chance = who[kept], node[kept], chance[kept]
                order = np.lexsort((node, -chance, who))
                who, node, chance = who[order], node[order], chance[order]
                running = np.cumsum(chance)
                start = np.searchsorted(who, some)
                stop = np.searchsorted(who, some, side="right")
                before = np.concatenate([[0.0], running])
                whole = before[stop] - before[start]
                short = whole < 1 - miss - 1e-9
                if bar < 1e-12:
                    short[:] = False
                late.append(some[short])
                ahead = running - chance - np.repeat(before[start], stop - start)
                kept = (ahead < 1 - miss - 1e-9) & ~np.repeat(short, stop - start)
                out.append((who[kept], node[kept]))
            rows, bar = np.concatenate(late), bar / 8
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def medians(values: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """The median of the values of each node, that of all where a node has none."""
    out = np.full(n, np.median(values) if len(values) else 0.0)
    order = np.lexsort((values, node))
    starts = np.searchsorted(node[order], np.arange(n + 1))
    sizes = np.diff(starts)
    held = np.flatnonzero(sizes)
    out[held] = values[order[starts[held] + sizes[held] // 2]]
    return out


def stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1) if len(column) else np.empty((0, 1), np.float32)


class Index:
    """Distinct unit vectors with an id each, and kd-trees that range them in cells of about `cell_rows`."""

    def __init__(self, vectors: DataFrame, dim: int, trees: int, cell_rows: int | None = None):
        self.dim = dim
        rows = unit_vectors(vectors, dim)
        # equal vectors are one; the name first in byte order stands for them
        self.members = cut(rows.distinct())
        classes = self.members.groupBy("unit").agg(F.min("chunk_id").alias("name"))
        self.vectors = cut(classes.select("name", "unit", F.xxhash64("name").alias("hash")).withColumn("id", F.monotonically_increasing_id()))
        self.n = self.vectors.count()
        sample = self.vectors.orderBy("hash", "name").limit(SAMPLE_ROWS).select("unit").toPandas().unit
        x = stacked(sample) if len(sample) else np.zeros((0, dim), np.float32)
        bits = max(0, int(np.ceil(np.log2(max(1, self.n) / (cell_rows or CELL_ROWS)))))
        self.trees = [Cells(x, bits, t) for t in range(trees)]


#: What cells exchange are vectors in half precision, which moves a distance by less than SLACK; the SPARE further candidates and the exact cosines at the end make up for it.
SLACK, SPARE = 5e-4, 3
ROW, ASKED, BOTH = 1, 2, 3
MEETING = "cell long, role int, id long, own long, unit binary, bound float"


def halves(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())


def unpacked(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def meetings(sides: DataFrame, k: int, least: float, trees: int) -> DataFrame:
    """(id, other, cosine): for each asked row the up to k most similar others of the rows in its cells with cosine >= `least`, in all `sides` (see MEETING) that share a cell.

    Each tree has projections of its own, so what the test of one misses another may find. A cell with more rows or queries than a task takes on is parted by hash into a grid, each part of its rows against each part of its queries.
    """
    row, asked = F.col("role").bitwiseAND(ROW) != 0, F.col("role").bitwiseAND(ASKED) != 0
    counts = sides.groupBy("cell").agg(F.count_if(row).alias("rows"), F.count_if(asked).alias("queries"))
    crowded = cut(counts.where((F.col("rows") > TASK_ROWS) | (F.col("queries") > TASK_ROWS)).select("cell", F.ceil(F.col("rows") / TASK_ROWS).cast("int").alias("across"), F.ceil(F.col("queries") / TASK_ROWS).cast("int").alias("down")))
    if crowded.isEmpty():
        placed = sides.withColumn("part", F.lit(0))
    else:
        known = sides.join(crowded, "cell", "left")
        plain = known.where("across is null").drop("across", "down").withColumn("part", F.lit(0))
        full = known.where("across is not null")
        at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
        steps = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        as_rows = full.where(row & (F.col("across") > 0) & (F.col("down") > 0)).withColumn("role", F.lit(ROW)).withColumn("j", steps(F.col("down"))).withColumn("part", at(F.col("across"), 1) * F.col("down") + F.col("j"))
        as_asked = full.where(asked & (F.col("across") > 0)).withColumn("role", F.lit(ASKED)).withColumn("j", steps(F.col("across"))).withColumn("part", F.col("j") * F.col("down") + at(F.col("down"), 2))
        placed = plain.union(as_rows.drop("across", "down", "j")).union(as_asked.drop("across", "down", "j"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        role = group.role.to_numpy()
        x, q = group[(role & ROW) != 0], group[(role & ASKED) != 0]
        if not len(x) or not len(q):
            return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
        i, j, c = search(unpacked(q.unit), q.own.to_numpy(np.int64), unpacked(x.unit), x.id.to_numpy(), k, least, start=q.bound.to_numpy(np.float32), seed=int(group.cell.iat[0]) % trees)
        return pd.DataFrame({"id": q.id.to_numpy()[i], "other": j, "cosine": c.astype(np.float64)})

    return placed.groupBy("cell", "part").applyInPandas(meet, "id long, other long, cosine double")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k most similar of each id, each other one once, with their place; what a task has cut to k is combined before."""
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def exact(found: DataFrame, asked: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """The candidates (id, other) with their cosines in full precision, cut to the k most similar with at least `least`; `asked` and `rows` are (id, unit)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.einsum("ij,ij->i", stacked(batch.column("a").to_pylist()), stacked(batch.column("b").to_pylist())) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("other"), pa.array(c.astype(np.float64))], names=["id", "other", "cosine"])

    met = found.select("id", "other").join(asked.select("id", F.col("unit").alias("a")), "id").join(rows.select(F.col("id").alias("other"), F.col("unit").alias("b")), "other")
    scored = met.select("id", "other", "a", "b").mapInArrow(score, "id long, other long, cosine double")
    return first_k(scored.where(F.col("cosine") >= least - 1e-6), k)


def homes(index: Index, rows: DataFrame, role: int, trees: int) -> DataFrame:
    """MEETING rows of (id, own, unit, bound) in their own cells of the first `trees` trees."""
    cells = index.trees[:trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column("unit").to_pylist())
                short = halves(x)
                for t, tree in enumerate(cells):
                    cell = pa.array(tree.of(x) * len(index_trees) + t)
                    yield pa.RecordBatch.from_arrays([cell, pa.array(np.full(len(x), role, np.int32)), batch.column("id"), batch.column("own"), short, batch.column("bound")], names=["cell", "role", "id", "own", "unit", "bound"])

    index_trees = index.trees
    return rows.select("id", "own", "unit", "bound").mapInArrow(run, MEETING)


def visits(index: Index, rows: DataFrame, miss: float) -> DataFrame:
    """MEETING rows of (id, own, unit, bound) in the cells they visit by the stopping test, without their own ones."""
    trees = index.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, bound = stacked(batch.column("unit").to_pylist()), np.asarray(batch.column("bound"), np.float32)
            batch = batch.set_column(batch.schema.get_field_index("unit"), "unit", halves(x))
            for t, tree in enumerate(trees):
                i, cell = tree.reached(x, bound, miss)
                other = tree.of(x)[i] != cell
                i, cell = i[other], cell[other]
                taken = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(cell * len(trees) + t), pa.array(np.full(len(i), ASKED, np.int32)), *(taken.column(c) for c in ("id", "own", "unit", "bound"))], names=["cell", "role", "id", "own", "unit", "bound"])

    return rows.select("id", "own", "unit", "bound").mapInArrow(run, MEETING)


def similar_classes(index: Index, k: int, least: float) -> DataFrame:
    """(id, other, cosine): for every distinct vector its up to k most similar others with cosine >= least.

    Every vector first searches its own cell of one tree; the distance of the k-th found there, or that of `least`, is the bound at which it
    then visits cells of all trees. So a vector amid many near copies goes no further than they lie, and what is shuffled per vector depends
    on the stopping test and the depth of the trees, not on the number of cells.
    """
    widest = 2 - 2 * least
    rows = index.vectors.select("id", F.col("id").alias("own"), "unit", F.lit(widest).cast("float").alias("bound"))
    first = first_k(meetings(homes(index, rows, BOTH, 1), k, least - SLACK, len(index.trees)), k)
    bounds = first.where(F.col("place") == k).select("id", F.pow(F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))) + SLACK, 2.0).cast("float").alias("nearer"))
    bounded = cut(rows.join(bounds, "id", "left").select("id", "own", "unit", F.least(F.when(F.col("nearer").isNotNull(), F.greatest("nearer", F.lit(1e-6))), "bound").cast("float").alias("bound")))
    sides = homes(index, bounded, BOTH, len(index.trees)).union(visits(index, bounded, TREE_MISS))
    candidates = first_k(meetings(sides, k + SPARE, least - SLACK, len(index.trees)), k + SPARE)
    return exact(candidates, index.vectors, index.vectors, k, least).drop("place")


def expand(index: Index, near: DataFrame, k: int) -> DataFrame:
    """(chunk_id, other, cosine, place): the k most similar chunks of each chunk, ties by chunk_id, equal vectors at cosine 1.

    A chunk needs at most k + 1 members of any class, so the members are cut to the k + 1 first names before they meet.
    """
    classes = index.vectors.select("unit", "id")
    members = cut(index.members.join(classes, "unit").select("id", "chunk_id"))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("chunk_id"))).where(F.col("n") <= k + 1).select(F.col("id").alias("other"), F.col("chunk_id").alias("other_chunk"))
    twins = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    met = near.select("id", "other", "cosine").union(twins).join(first, "other").join(members, "id").where("chunk_id <> other_chunk")
    best = Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "other_chunk")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("chunk_id", F.col("other_chunk").alias("other"), "cosine", "place")


def similar_pairs(vectors: DataFrame, dim: int = 96, k: int = 5, least: float = 0.85) -> DataFrame:
    """(chunk_id_a, chunk_id_b, cosine), a < b: pairs with cosine >= least of which one is among the k most similar of the other.

    Vectors are scaled to length one; null, all-zero and non-finite vectors and those of another length than `dim` take no part, nor do null
    chunk_ids; a vector delivered twice counts once. Of more than k equally similar ones those first by chunk_id are taken. An empty table gives
    an empty result; further columns are ignored. The search is approximate: a pair at the bound is missed with a chance of about
    TREE_MISS ** TREES + MISS at most, a nearer one with far less; cosines are exact to float32.
    """
    index = Index(vectors, dim, TREES)
    found = expand(index, similar_classes(index, k, least), k).where(F.col("cosine") >= least)
    return found.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b"), "cosine").groupBy("chunk_id_a", "chunk_id_b").agg(F.max("cosine").alias("cosine"))


def nearest(vectors: DataFrame, queries: DataFrame, dim: int = 96, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, cosine, place): the k most similar other chunks of each query chunk, against all rows.

    `queries` has the columns of `vectors`. A query searches its own cell first; the k-th distance found there is the bound at which it visits
    further cells of the same tree, until the chance that those left hold a neighbour at the bound is at most MISS. Unusable vectors are treated
    as in similar_pairs; fewer than k others give fewer rows.
    """
    index = Index(vectors, dim, 1)
    asked = unit_vectors(queries, dim).distinct().withColumn("qid", F.monotonically_increasing_id())
    asked = cut(asked.select("qid", "chunk_id", "unit"))
    with_own = cut(asked.join(index.vectors.select("unit", F.col("id").alias("own")), "unit", "left").select("qid", "own", "unit"))
    far = F.lit(4.0).cast("float")
    queried = with_own.select(F.col("qid").alias("id"), F.coalesce("own", F.lit(-1)).alias("own"), "unit", far.alias("bound"))
    rows = homes(index, index.vectors.select("id", F.col("id").alias("own"), "unit", far.alias("bound")), ROW, 1)
    first = cut(first_k(meetings(rows.union(homes(index, queried, ASKED, 1)), k + SPARE, -1.0, 1), k + SPARE))
    bounds = first.where(F.col("place") == k).select("id", (2 - 2 * F.col("cosine")).cast("float").alias("nearer"))
    bounded = cut(queried.join(bounds, "id", "left").select("id", "own", "unit", F.coalesce("nearer", "bound").alias("bound")))
    candidates = first_k(first.drop("place").union(meetings(rows.union(visits(index, bounded, MISS)), k + SPARE, -1.0, 1)), k + SPARE)
    near = exact(candidates, with_own.select(F.col("qid").alias("id"), "unit"), index.vectors, k, -1.0).withColumnRenamed("id", "qid")
    own = with_own.select("qid", F.col("own").alias("other"), F.lit(1.0).alias("cosine")).where("other is not null")
    first_members = index.members.join(index.vectors.select("unit", "id"), "unit").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("chunk_id"))).where(F.col("n") <= k + 1).select(F.col("id").alias("other"), F.col("chunk_id").alias("other_chunk"))
    met = near.select("qid", "other", "cosine").union(own).join(first_members, "other").join(asked.select("qid", "chunk_id"), "qid").where("chunk_id <> other_chunk")
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "other_chunk")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(F.col("chunk_id").alias("query_id"), F.col("other_chunk").alias("chunk_id"), "cosine", "place")
