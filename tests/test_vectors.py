import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import vectors as vx
from pagewright.operators import embed, index, reduce, similarity, training
from pagewright.plans import queries


def rows(spark, x, name="row_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<double>")


def test_exact_similarities(spark):
    x = [[1, 0, 0], [0, 1, 0], [1, 0, 0]]
    got = {(r.query_id, r.row_id): r.similarity for r in similarity.similarities(rows(spark, x, "query_id"), rows(spark, x)).collect()}
    assert got == {(i, j): float(np.dot(x[i], x[j])) for i in range(3) for j in range(3)}


def test_blocks_agree(spark):
    x = np.random.default_rng(1).normal(size=(40, 8))
    q, r = rows(spark, x[:30], "query_id"), rows(spark, x)
    one = {(a.query_id, a.row_id) for a in similarity.similarities(q, r, k=3).collect()}
    two = {(a.query_id, a.row_id) for a in similarity.similarities(q, r, k=3, block=7).collect()}
    exact = {(i, j) for i in range(30) for j in np.argsort(-(x[i] @ x.T), kind="stable")[:3]}
    assert one == two == exact


def test_accuracy_and_mrr(spark):
    eye = np.eye(6)
    for shift, accuracy in ((0, 1.0), (1, 0.0)):
        scores = similarity.similarities(rows(spark, eye, "query_id"), rows(spark, np.roll(eye, shift, 0)))
        got = similarity.accuracy_and_mrr(similarity.own_ranks(scores, F.col("query_id") == F.col("row_id"))).first()
        assert got.accuracy == accuracy and 0 < got.mrr <= 1
        if not shift:
            assert got.mrr == 1


def test_evaluate(spark):
    top = spark.createDataFrame([(0, r, i) for i, r in enumerate([3, 1, 7, 2, 9], 1)], "query_id long, row_id long, rank int")
    relevant = spark.createDataFrame([(0, 7), (0, 9), (0, 50)], "query_id long, row_id long")
    got = similarity.evaluate_retrieval(top, spark.createDataFrame([(0,), (1,)], "query_id long"), relevant).first()
    assert (got.precision_at_1, got.precision_at_5, got.mrr) == (0.0, 0.2, pytest.approx(1 / 6))


def test_hard_negatives(spark):
    s = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.6), (0, 2, 0.4)], "query_id long, row_id long, similarity double")
    assert [r.row_id for r in similarity.hard_negatives(s).collect()] == [1]


def test_ivf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r.row_id) for r in index.ivf_top_k(rows(spark, x[:50], "query_id"), rows(spark, x), k=5, probes=20, slice_rows=40).collect()}
    exact = {(i, j) for i in range(50) for j in np.argsort(-(x[i] @ x.T))[:5]}
    assert len(got & exact) >= 0.9 * len(exact)
    assert index.n_cells(3) == 1 and index.n_cells(5000) == 100
    with pytest.raises(ValueError):
        index.build_index("tree")


def test_ivf_recall_by_default(spark):
    """At the settings of the registered query, the query itself not counted."""
    x = np.random.default_rng(7).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for step in (100, 10):  # as many queries as the registered one has, and more
        own = range(0, 2000, step)
        q = spark.createDataFrame([(i, x[i].tolist()) for i in own], "query_id long, embedding array<double>")
        got = {(r.query_id, r.row_id) for r in index.ivf_top_k(q, rows(spark, x), k=5).collect()}
        exact = {(i, int(j)) for i in own for j in np.argsort(-(x[i] @ x.T))[1:5]}
        assert len(got & exact) >= 0.9 * len(exact)
        assert len(got) == 5 * len(own)


def test_pivot_of_the_whole_query_set(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(8).normal(size=(901, 4))
    table = spark.createDataFrame([(i, [float(v) for v in r], "a") for i, r in enumerate(x)], "vec_id long, embedding array<float>, label string")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    ids = range(0, 901, 100)
    got = {r.query_id: r for r in queries.similarity_pivot(spark, str(tmp_path)).collect()}
    assert set(got) == set(ids) and set(got[0].asDict()) == {"query_id", *(f"s{i}" for i in ids)}
    assert all(got[i][f"s{j}"] == pytest.approx(x[i] @ x[j], abs=6e-4) for i in ids for j in ids)
    monkeypatch.setattr(queries, "PIVOT_COLUMNS", 9)
    with pytest.raises(ValueError):
        queries.similarity_pivot(spark, str(tmp_path))


def test_all_hits_of_a_batch_search(spark, tmp_path):
    """Five ranked sections for each query; of sections with equal text the one with the smaller id comes first."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(15)] * 2
    asked = [(100 * i, " ".join(rng.choices(words, k=4))) for i in range(8)]
    spark.createDataFrame([(i + j, q) for i, q in asked for j in (0, 0, 1)], "pair_id long, query string").write.parquet(str(tmp_path / "pairs_df.parquet"))
    columns = "doc_id string, section_idx int, section_id string, title string, sec_level int, page_start int, page_end int, text string, source_pdf string"
    spark.createDataFrame([(f"d{i % 7}", i, "", "", 1, 1, 1, t, "") for i, t in enumerate(texts)], columns).write.parquet(str(tmp_path / "doc_sections.parquet"))
    got = {(r.query_id, r.rank): (r.row_id, r.similarity) for r in queries.QUERIES["search_batch_hits"](spark, str(tmp_path)).collect()}
    named = [(f"d{i % 7}/{i:03d}", t) for i, t in enumerate(texts)]
    both = spark.createDataFrame([(a, b) for a, b in [*asked, *named] for a in [str(a)]], "id string, t string").select("id", embed.hash_embedding(F.col("t")).alias("v"))
    v = {r.id: np.array(r.v) for r in both.collect()}
    want = {}
    for i, _ in asked:
        best = sorted((-round(float(v[str(i)] @ v[name]), 9), name) for name, _ in named)[:5]
        want |= {(i, k): (name, pytest.approx(-s, abs=2e-6)) for k, (s, name) in enumerate(best, 1)}
    assert got == want


def test_empty_vectors(spark):
    none = rows(spark, []).where("false")
    assert similarity.similarities(none.withColumnRenamed("row_id", "query_id"), none).count() == 0


def test_expressions(spark):
    r = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(vx.norm(F.col("v")).alias("n"), vx.l2_normalize(F.col("v")).alias("u"), vx.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert r.n == 5 and r.u == pytest.approx([0.6, 0.8]) and r.c == pytest.approx(1)


def test_hash_embedding(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(embed.hash_embedding(F.col("t")).alias("v"))
    v = [r.v for r in df.collect()]
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not any(v[1]) and not any(v[2])


def test_contrastive_loss(spark):
    pairs = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0]), (1, [0.0, 1.0], [0.0, 1.0])], "pair_id long, anchor array<double>, positive array<double>")
    loss = training.contrastive_losses(training.batch_numbers(pairs, 2)).first().loss
    assert loss == pytest.approx(math.log(math.e + 1) - 1)


def test_gradient():
    rng = np.random.default_rng(3)
    a, p, down, up = rng.normal(size=(4, 5)), rng.normal(size=(4, 5)), rng.normal(size=(2, 5)), rng.normal(size=(5, 2))
    loss, gd, gu = training.batch_gradient(a, p, down, up, 2.0, 0.5)
    for w, g in ((down, gd), (up, gu)):
        w[0, 1] += 1e-6
        assert (training.batch_gradient(a, p, down, up, 2.0, 0.5)[0] - loss) / 1e-6 == pytest.approx(g[0, 1], rel=1e-3, abs=1e-5)
        w[0, 1] -= 1e-6


def test_training_lowers_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(32, 8))
    rows_ = [(i, [float(v) for v in r], [float(v) for v in r + 0.8 * rng.normal(size=8)]) for i, r in enumerate(x)]
    pairs = spark.createDataFrame(rows_, "pair_id long, anchor array<double>, positive array<double>")
    losses, _ = training.train_adapter(pairs, training.AdapterConfig(r=4, epochs=4, batch_size=8, learning_rate=0.02), steps_per_epoch=2)
    assert losses[-1] < losses[0]


def test_pca(spark):
    x = np.random.default_rng(5).normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    got = np.array([[r.x0, r.x1] for r in reduce.pca(rows(spark, x), "row_id").orderBy("row_id").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(c @ vt[:2].T), abs=1e-6)


def test_tsne_parts_clusters():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (20, 4)), rng.normal(5, 0.1, (20, 4))])
    y = reduce.tsne(x, 10)
    a, b = y[:20].mean(0), y[20:].mean(0)
    assert np.linalg.norm(a - b) > y[:20].std() + y[20:].std()


def test_batches_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 977).alias("pair_id"))
    got = {r.pair_id: r.batch for r in training.batch_numbers(df, 64).collect()}
    assert all(got[i * 977] == i // 64 for i in range(5000))
    drawn = training.batch_numbers(df, 64, seed=3).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in drawn] == [64] * 78 + [8]


def test_blocks_of_queries(spark, monkeypatch):
    """Beyond the size that is sent to every task blocks meet slices, with the same result, labels left out where asked."""
    monkeypatch.setattr(similarity, "SLICE_ROWS", 70)
    monkeypatch.setattr(similarity, "AT_ONCE", 16)
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 3 if i else None) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int")
    q = df.where("row_id < 90").withColumnRenamed("row_id", "query_id")
    few, many = (similarity.similarities(q, df, k=4, unlike="label", **o) for o in ({}, {"block": 20}))
    key = lambda d: sorted((r.query_id, r.row_id, round(r.similarity, 9)) for r in d.collect())
    assert key(few) == key(many) and len(key(few)) == 89 * 4
    assert all(a % 3 != b % 3 for a, b, _ in key(many))


def test_adapter_settings(spark, tmp_path):
    with pytest.raises(ValueError):
        training.AdapterConfig(target_modules=("elsewhere",))
    rng = np.random.default_rng(1)
    pairs = spark.createDataFrame([(i, [float(x) for x in v], [float(x) for x in v + 0.1]) for i, v in enumerate(rng.normal(size=(10, 5)))], "pair_id long, anchor array<double>, positive array<double>")
    losses, m = training.train_adapter(pairs, training.AdapterConfig(r=2, epochs=2, batch_size=4, lora_dropout=0.5, target_modules=("anchor",)), steps_per_epoch=None, sequential=True)
    again, _ = training.train_adapter(pairs, training.AdapterConfig(r=2, epochs=2, batch_size=4, lora_dropout=0.5, target_modules=("anchor",)), steps_per_epoch=None, sequential=True)
    assert losses == again and len(losses) == 2
    out = training.apply_adapter(pairs.union(spark.createDataFrame([(99, None, None)], pairs.schema)), m, {"r": 2, "lora_alpha": 4}, "anchor").orderBy("pair_id").collect()
    assert out[-1].adapted is None and all(abs(sum(x * x for x in r.adapted) - 1) < 1e-9 for r in out[:-1])
