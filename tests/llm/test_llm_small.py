"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, further columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import cross_split, grouped_splits, mixing, neighbours, packing, pair_defects, quality, repeated_lines, scan_repair
from pagewright.llm.boosting import Boosted

WORDS = [("the", "en"), ("of", "en"), ("and", "en"), ("is", "en"), ("in", "en"), ("to", "en"), ("la", "fr"), ("le", "fr"), ("est", "fr"), ("dans", "fr"), ("sur", "fr"), (None, "fr")]


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w, lang, 1) for w, lang in WORDS], "word string, lang string, freq_rank int")


# -- 1


CATALOG = "doc_id string, title string, author string"
RECORDS = "pair_id long, doc_id string, chunk_id string, src string"


def test_groups(spark):
    catalog = spark.createDataFrame(
        [("a_one_1", "", "Dr. Mira Kél"), ("b_two_2", "", "KEL, MIRA; Unknown"), ("c_three_3", "", "unknown"), ("d_four_4", "", "Unknown"), ("e_five_5", "", None), ("f_six_6", "", "n/a"), (None, "", "Mira Kel"), ("z_last", "", "by Orr  Tam & mira kel")], CATALOG
    )
    pairs = spark.createDataFrame(
        [
            (1, "data/raw/B_TWO_2.pdf", None, "s"), (2, None, "c-three-3:sec001:chunk00001", "s"), (3, "c_three_3", "D Four 4::SEC000::CHUNK00001", "s"), (4, "E Five 5", "chunk_7", "s"), (5, "nan", "", "s"),
            (6, "z_last", "a_one_1::sec000::chunk00000", "s"), (6, "z_last", "a_one_1::sec000::chunk00000", "s"), (None, "a_one_1", None, "s"), (7, "f_six_6", None, "s"),
        ], RECORDS,
    ).withColumn("node", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.pair_id: r.group_doc for r in grouped_splits.record_groups(pairs, catalog).collect()}
    assert got == {1: "a_one_1", 2: "c_three_3", 3: "c_three_3", 4: "e_five_5", 5: None, 6: "a_one_1", 7: "f_six_6"}
    empty = grouped_splits.record_groups(pairs.where("false"), catalog)
    assert empty.count() == 0
    assert {r.group_doc for r in grouped_splits.record_groups(pairs, catalog.where("false")).collect()} == {None}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(110)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"h{i:03d}") for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in grouped_splits.components(spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string")).collect()}
    assert all(find(x) == got.get(x, x) for e in edges for x in e)


def test_splits(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(200)}" if i % 3 else "hot", f"s{rng.randrange(5)}") for i in range(3000)] + [(3000 + i, None, None) for i in range(50)]
    df = spark.createDataFrame(rows, "pair_id long, group_doc string, src string")
    targets = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2), (None, 0.5)], "split_name string, target_share double")
    out = grouped_splits.grouped_splits(df, targets).join(df, "pair_id")
    assert out.count() == 3050
    assert out.where("group_doc is not null").groupBy("group_doc").agg(F.count_distinct("split_name").alias("n")).where("n > 1").count() == 0
    share = {r.split_name: r.n / 3050 for r in out.groupBy("split_name").agg(F.count("*").alias("n")).collect()}
    assert abs(share["train"] - 0.6) < 0.05 and abs(share["val"] - 0.2) < 0.05
    assert grouped_splits.grouped_splits(df.where("false"), targets).count() == 0
    with pytest.raises(ValueError):
        grouped_splits.grouped_splits(df, targets.where("false"))


# -- 2


def vectors(spark, x, ids=None):
    rows = [(i, f"c{i:04d}" if ids is None else ids[i], None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, chunk_id string, embedding array<float>")


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:30] + 0.08 * rng.normal(size=(30, 24)), base[:9], rng.normal(size=(200, 24))]) * rng.uniform(0.1, 9, (299, 1))
    bad = [None, [0.0] * 24, [1.0] * 5, [float("nan")] * 24, [float("inf")] * 24]
    df = vectors(spark, [*x, *bad])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"c{i:04d}", f"c{j:04d}"))) for i in range(299) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neighbours.similar_pairs(df.union(df.limit(40)), dim=24).collect()}
    assert got == want
    assert neighbours.similar_pairs(df.where("false"), dim=24).count() == 0


def test_many_copies_and_blocks(spark, monkeypatch):
    """A third of all rows are one vector; small blocks, so that cells and slices are many."""
    monkeypatch.setattr(neighbours, "TASK_ROWS", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile(rng.normal(size=(1, 24)), (120, 1)), rng.normal(size=(120, 24))])
    x = np.concatenate([x, x[120:180] + 0.05 * rng.normal(size=(60, 24))])
    index = neighbours.Index(vectors(spark, x), 24, neighbours.TREES, cell_rows=64)
    near = neighbours.expand(index, neighbours.similar_classes(index, 5, 0.85), 5).where("cosine >= 0.85").collect()
    per = {}
    for r in near:
        per.setdefault(r.chunk_id, []).append(r.other)
    assert per["c0000"] == [f"c{i:04d}" for i in range(1, 6)] and len(per["c0119"]) == 5
    assert all(f"c{i + 120:04d}" in per.get(f"c{i:04d}", []) for i in range(120, 180)) or sum(f"c{i + 120:04d}" in per.get(f"c{i:04d}", []) for i in range(120, 180)) >= 58


def test_cells_hold_what_their_test_admits():
    """Neighbours at the bound lie in the cells reached about as often as the test says, and a tree below the sample's levels stays even."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    cells = neighbours.Cells(x[:2000], 12, 0)
    assert np.bincount(np.bincount(cells.of(x), minlength=4096)).argmax() <= 2
    step = rng.normal(size=x.shape)
    y = x + (0.5 * step / np.linalg.norm(step, axis=1, keepdims=True)).astype(np.float32)
    for miss in (0.5, 0.1):
        i, cell = cells.reached(x, np.full(len(x), 0.25, np.float32), miss)
        found = set(i[cells.of(y)[i] == cell].tolist())
        assert abs(len(found) / len(x) - (1 - miss)) < 0.1
        assert len(set(zip(i.tolist(), cell.tolist()))) == len(i)


def test_a_third_near_copies(spark, monkeypatch):
    """Near copies that are not equal: their cells are crowded, and every one still finds its nearest."""
    monkeypatch.setattr(neighbours, "TASK_ROWS", 60)
    rng = np.random.default_rng(9)
    hot = rng.normal(size=(1, 24)) + 0.02 * rng.normal(size=(150, 24))
    x = np.concatenate([hot, rng.normal(size=(300, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"c{i:04d}", f"c{j:04d}"))) for i in range(450) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    index = neighbours.Index(vectors(spark, x), 24, neighbours.TREES, cell_rows=30)
    got = {tuple(sorted((r.chunk_id, r.other))) for r in neighbours.expand(index, neighbours.similar_classes(index, 5, 0.85), 5).where("cosine >= 0.85").collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = vectors(spark, x)
    got = {(r.query_id, r.chunk_id) for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), dim=32, k=10).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {(f"c{i:04d}", f"c{j:04d}") for i in range(0, 1500, 100) for j in np.argsort(-s[i])[:10]}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


# -- 3


PAGES = "page_id long, doc_id string, page_number int, raw_text string, line_list array<string>"


def test_repeated_lines(spark):
    rng = random.Random(6)
    notice = "Copyright 20%02d Some Press. All rights reserved"
    pages, sections = [], []
    for d in range(12):
        source = "Lib\\Shelf_A" if d % 2 else "x/y/shelf_a"
        sections.append((f"d{d}", f"{source}/f{d}.pdf"))
        for p in range(2):
            lines = [f"word{rng.randrange(10**6)} stands alone {rng.randrange(10**6)} times" for _ in range(4)]
            if d < 4 and p == 0:
                lines[1] = notice % d
            if d in (5, 6):
                lines[2] = "only two documents hold this line"
            pages.append((d * 10 + p, f"d{d}", p + 1, "", [*lines, "12345", None, ""]))
    pages += [pages[0], (900, None, 1, "", ["x"]), (901, "d0", 3, "", None), (902, "d1", 3, "", []), (903, "nosource", 1, "", [notice % 1])]
    df = spark.createDataFrame(pages, PAGES).withColumn("source", F.lit("clash"))
    sec = spark.createDataFrame([*sections, ("d0", None), (None, "a/b.pdf"), ("d1", "nofolder.pdf")], "doc_id string, source_pdf string")
    got = sorted((r.page_id, r.line_no) for r in repeated_lines.repeated_lines(df, sec).collect())
    keys = {}
    for i, d, _, _, lines in pages:
        for n, x in enumerate(lines or [], 1):
            k = "".join(c for c in (x or "").lower() if c.isalpha())
            if d and d != "nosource" and k:
                keys.setdefault(k, set()).add(d)
    want = sorted({(i, n) for i, d, _, _, lines in pages for n, x in enumerate(lines or [], 1) if d and d != "nosource" and (k := "".join(c for c in (x or "").lower() if c.isalpha())) and len(keys[k]) >= 3 and len(keys[k]) >= 3})
    assert got == want and (0, 2) in got
    cleaned = {r.page_id: r for r in repeated_lines.clean_pages(df, spark.createDataFrame(got, "page_id long, line_no int")).collect()}
    assert cleaned[0].n_removed >= 1 and cleaned[901].kept_lines is None
    assert repeated_lines.repeated_lines(df.where("false"), sec).count() == 0 == repeated_lines.repeated_lines(df, sec.where("false")).count()


def test_chunks_depend_on_their_line_alone():
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 200))) for _ in range(60)]

    def chunks(some):
        data = "".join(some).encode()
        offsets = np.cumsum([0, *map(len, some)])
        h, at = repeated_lines.chunk_hashes(np.frombuffer(data, np.uint8), offsets)
        return {x: tuple(h[at[i] : at[i + 1]]) for i, x in enumerate(some)}

    one, two = chunks(lines), chunks(lines[::-1])
    assert one == two and all(one[x] for x in lines)
    assert max(map(len, one.values())) > 5


# -- 4


def test_divided_words(spark):
    joins = scan_repair.train_joins([("council", 50), ("long-running", 20), ("committee", 30), ("harbour", 40), ("running", 9)])
    count = {"council": 50, "long-running": 20, "committee": 30}.get
    lines = [(1, "the coun-"), (2, "cil met a long-"), (3, "running com¬"), (4, "mittee. vector —"), (5, "- item")]
    assert scan_repair.divided(lines, joins, lambda w: count(w, 0)) == [(1, "council"), (2, "long-running"), (3, "committee")]


def test_page_noise(spark):
    rng = random.Random(8)
    nouns = "council harbour committee glacier battery solvent retriever benchmark catalogue schedule theorem windmill".split()
    sentence = lambda: f"The {rng.choice(nouns)} near every {rng.choice(nouns)} lowers another {rng.choice(nouns)} before the {rng.choice(nouns)} closes."
    rows = []
    for d in range(30):
        for p in range(1, 5):
            lines = [sentence() for _ in range(6)]
            if d == 0:
                lines = ["Market Handbook", *lines, f"- {p + 40} -"]
            if d == 1 and p == 2:
                lines[2] = "The har-\nbour stays."
            if d == 2 and p == 3:
                lines[3] = "The cornmittee and the so1vent and Kamusega stay."
            rows.append((d * 10 + p, f"d{d}", p, "\n".join(lines), None))
    rows += [rows[0], (999, "d3", 9, None, None), (998, "d3", 10, "", None), (997, None, 1, "1206", None)]
    pages = spark.createDataFrame(rows, PAGES)
    catalog = spark.createDataFrame([(f"d{d}", "The Market Handbook" if d == 0 else f"Title {d} Notes", None) for d in range(30)] + [(None, None, None)], CATALOG)
    got = {(r.page_id, r.noise_kind) for r in scan_repair.page_noise(pages, catalog).collect()}
    assert got == {(p, k) for p in range(1, 5) for k in ("running_header", "page_number")} | {(12, "hyphen_break"), (23, "misread")}
    fixed = scan_repair.repaired_pages(pages, catalog)
    text = {(r.page_id): r.paragraph for r in fixed.collect()}
    assert "harbour stays" in text[12] and "committee and the solvent and Kamusega" in text[23] and "Market Handbook" not in text[1] and "41" not in text[1]


def test_rare_words_at_line_ends(spark, monkeypatch):
    """Compounds keep their hyphen though they are on few pages and beyond the words that the classifiers learn from."""
    monkeypatch.setattr(scan_repair, "SAMPLE", 60)
    letters = random.Random(13)
    made = ["".join(letters.choices("abcdeghiklmnoprstu", k=8)) for _ in range(60)]
    rows = [(p, f"d{p}", 1, "\n".join(" ".join(made[(p + k) % 60 : (p + k) % 60 + 6]) + "." for k in range(12)), None) for p in range(60)]
    rows += [(100 + p, "e", p, "They saw the river-bank there.\nIt is a landmark too.", None) for p in range(3)]
    rows += [(200, "f", 1, "They stood on the river-\nbank at noon. The old land-\nmark stood too.", None)]
    pages, catalog = spark.createDataFrame(rows, PAGES), spark.createDataFrame([("f", "A Title", None)], CATALOG)
    text = {r.page_id: r.paragraph for r in scan_repair.repaired_pages(pages, catalog).collect()}
    assert text[200] == "They stood on the river-bank at noon. The old landmark stood too."
    assert (200, "hyphen_break") in {(r.page_id, r.noise_kind) for r in scan_repair.page_noise(pages, catalog).collect()}


def test_paragraphs_over_pages(spark):
    """A paragraph goes on over blank pages and many pages, a word divided at a page end stands whole on the first page, an item begins anew."""
    letters = random.Random(14)
    made = ["".join(letters.choices("abcdeghiklmnoprstu", k=8)) for _ in range(60)]
    rows = [(1000 + p, f"x{p}", 1, "\n".join(" ".join(made[(p + k) % 60 : (p + k) % 60 + 6]) + "." for k in range(12)) + "\nThe harbour was the old market.", None) for p in range(40)]
    rows += [(1, "d", 1, "First words here.\n\nThe old mar-", None), (2, "d", 2, "", None), (3, "d", 3, "ket, it was\nbusy and", None), (4, "d", 4, "open.\n\nThen it goes on", None), (5, "d", 5, "- an item", None), (6, "d", 6, "and more of it.", None), (6, "d", 6, "and more of it.", None)]
    rows += [(5000 + p, "long", p, "opening words" if p else "Long ago", None) for p in range(600)] + [(7000, None, 1, "no document", None), (7001, "d", None, "no number", None)]
    got = scan_repair.repaired_pages(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], CATALOG)).cache()
    joined = {(r.doc_id, r.start_page_id, r.start_no): (r.text, r.page_start, r.page_end) for r in scan_repair.document_paragraphs(got).where("doc_id in ('d', 'long')").collect()}
    assert joined == {
        ("d", 1, 1): ("First words here.", 1, 1), ("d", 1, 2): ("The old market, it was busy and open.", 1, 4), ("d", 4, 2): ("Then it goes on", 4, 4), ("d", 5, 1): ("- an item and more of it.", 5, 6),
        ("d", 7001, 1): ("no number", None, None), ("long", 5000, 1): ("Long ago " + " ".join(["opening words"] * 599), 0, 599),
    }
    assert {r.page_id: r.paragraph for r in got.where("page_id in (3, 7000)").collect()} == {3: "it was busy and", 7000: "no document"}


def test_pages_count_once(spark):
    """A page delivered three times weighs as one."""
    pages = spark.createDataFrame([(1, "d", 1, "alpha beta", None)] * 3 + [(2, "d", 2, "alpha", None)], PAGES)
    weighted, n = scan_repair.deliveries(pages)
    assert n == 2 and {r.word: (r.n, r.solid) for r in scan_repair.vocabulary(weighted).collect()} == {"alpha": (2, 2), "beta": (1, 1)}


def test_gram_join_loses_nothing(spark):
    """Every pair that shares enough grams at lengths two apart at most meets, as by comparing all."""
    letters = random.Random(15)
    known = sorted({"".join(letters.choices("abcde", k=letters.randint(2, 11))) for _ in range(150)})
    rare = sorted({scan_repair.spoil(w, letters) for w in known} | {w[:-1] + "x" for w in known if len(w) > 2} - set(known))
    grams = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    want = {(a, b) for a in rare for b in known if a != b and abs(len(a) - len(b)) <= 2 and len(grams(a) & grams(b)) >= scan_repair.least_shared(max(len(a), len(b)))}
    frame = lambda words: spark.createDataFrame([(w, 1) for w in words if 2 <= len(w) <= 30], "word string, n long")
    rarity = np.arange(scan_repair.GRAM_BUCKETS) * 7919 % 31
    a, b = scan_repair.gram_keys(frame(rare), rarity, True), scan_repair.gram_keys(frame(known), rarity, False).withColumnRenamed("word", "meant")
    met = {(r.word, r.meant) for r in a.join(b, ["gram", "size"]).select("word", "meant").distinct().collect()}
    assert {x for x in want if len(x[0]) >= 2} <= met


def test_targets_in_a_large_corpus(spark):
    """A word on five pages is what its misreading means, however many pages there are."""
    words = spark.createDataFrame([("glacier", 20), ("g1acier", 1)], "word string, n long")
    ranker = scan_repair.train_ranker([("council", 50), ("harbour", 40), ("glacier", 20), ("committee", 30), ("battery", 20)])
    assert [tuple(r) for r in scan_repair.corrections(words, ranker, 10**6).collect()] == [("g1acier", "glacier")]


def test_empty_pages(spark):
    pages, catalog = spark.createDataFrame([], PAGES), spark.createDataFrame([], CATALOG)
    assert scan_repair.page_noise(pages, catalog).count() == 0 and scan_repair.repaired_pages(pages, catalog).count() == 0


def test_boosting_learns():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = Boosted(60, 3).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


# -- 5


def test_cross_split(spark):
    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, n = [], 0
    for i in range(120):
        base = [word() for _ in range(60)]
        rows.append((n := n + 1, f"Query {i}?", " ".join(base), "train"))
        if i % 3 == 0:
            other = [w if rng.random() > 0.12 else word() for w in base]
            rows.append((n := n + 1, f"QUÉRY {i} !" if i % 2 else f"other {n}", ", ".join(other).upper(), "val" if i % 2 else "test"))
        if i % 10 == 0:
            rows.append((n := n + 1, None, " ".join(base), "train"))
            rows.append((n := n + 1, "", " ".join(base), "test"))
    rows += [(n + 1, "???", None, "val"), (n + 2, "!!!", "", "train"), (n + 3, "x", "short text", "train"), (n + 4, "X", "short text", "val"), (n + 5, "x", "short text", "dev"), rows[1], (None, "x", "y", "val")]
    df = spark.createDataFrame(rows, "pair_id long, query string, passage string, split_name string").withColumn("words", F.lit(1))
    got = {(r.pair_id_a, r.pair_id_b) for r in cross_split.cross_split_pairs(df).collect()}
    parts = {}
    for i, q, p, s in rows:
        if i is None:
            continue
        w = ["".join(c for c in x if c.isalnum()) for x in (p or "").lower().split()]
        parts[i] = (cross_split.query_key(q), set(zip(w, w[1:], w[2:])) if len(w) >= 30 else set(), s)
    want = set()
    for i, (qa, a, s) in parts.items():
        for j, (qb, b, t) in parts.items():
            if s == "train" and t in ("val", "test") and (qa and qa == qb or a and b and len(a & b) / max(len(a), len(b)) >= 0.5):
                want.add((min(i, j), max(i, j)))
    assert got == want
    assert cross_split.cross_split_pairs(df.where("false")).count() == 0


def test_cross_split_in_a_large_group(spark):
    """Near copies of one text: what they share is frequent, what each has of its own is rare, and every pair at the bound still counts."""
    rng = random.Random(12)
    word = iter(range(10**6))
    rows = []
    for own in (10, 30, 50):
        base = [f"g{own}x{i}" for i in range(102 - own)]
        for i in range(60):
            rows.append((len(rows) + 1, None, " ".join([*base, *(f"o{next(word)}" for _ in range(own))]), rng.choice(("train", "val", "test"))))
    rows += [(len(rows) + 1 + i, None, " ".join(f"u{next(word)}" for _ in range(40)), "train") for i in range(400)]
    got = {(r.pair_id_a, r.pair_id_b) for r in cross_split.cross_split_pairs(spark.createDataFrame(rows, "pair_id long, query string, passage string, split_name string")).collect()}
    sets = [(i, set(zip(w, w[1:], w[2:])), s == "train") for i, _, p, s in rows[:180] for w in [p.split()]]
    want = {(i, j) for i, a, s in sets for j, b, t in sets if i < j and s != t and 2 * len(a & b) >= max(len(a), len(b))}
    assert len(want) > 2000 and got == want


def test_query_key():
    assert cross_split.query_key("Éa ﬁ-2?") == cross_split.query_key("EA FI 2") == "eafi2" and cross_split.query_key("?!") is None and cross_split.query_key(None) is None


# -- 6


@pytest.mark.parametrize(
    "query, passage, defect",
    [
        ("Who met?", None, "empty"), ("Who met?", "​ \n", "empty"), ("Who met?", "<p></p>", "empty"), ("Who met?", "N/A", "empty"), ("Who met?", "...", "empty"), ("Who met?", "Answer:", "empty"),
        ("Who met the old council?", "I'm sorry, but I can't help with that. Let me know if you have other questions.", "refusal"), ("Who met?", "There is not enough context to answer the question.", "refusal"),
        ("Who met?", "My guidelines do not allow an answer here.", "refusal"), ("Who met?", 'The operator answered: "I am sorry, the pump is closed." It was late.', None),
        ("Who met the old council?", "You asked: who met the old council", "copied"), ("Who met the old council?", "Who met the old council? Who met the old council?", "copied"), ("Who met the old council?", "The old council met.", None),
        ("Who met the old council?", "Le conseil est sur la place dans la ville, le maire est dans la salle et le public est sur la route.", "language"),
        ("Quel est le conseil dans la ville ?", "Le conseil est sur la place dans la ville, le maire est dans la salle et le public est sur la route.", None),
        ("Who met?", "The council of the town met in the hall and the", "truncated"), ("Who met?", "The council met. It spoke of (", "truncated"), ("Who met?", "The council met. [3, p. 41]", None), ("Who met?", "The council met. (ibid.)", None),
        ("Who met?", "```\ncode here.", "truncated"), ("Who met?", "They are:\n- the mayor\n- the clerk", None), ("Who met?", '"The council met."', None), ("Who met?", "Nobody.", None), (None, "The council met.", None),
    ],
)
def test_defects(query, passage, defect):
    lists = {}
    for w, lang in WORDS:
        if w:
            lists.setdefault(lang, set()).add(w)
    assert pair_defects.Judge({k: frozenset(v) for k, v in lists.items()})(query, passage) == defect


def test_refusals_in_other_words():
    """Wordings that stand in none of the tables: those that decline, and sound answers with words of refusal in them."""
    declining = ["That one's above my pay grade, so I'll have to pass on it.", "This is not a matter on which I am at liberty to speak.", "I'd prefer not to get into that.", "The material at hand is silent on the matter, so I cannot answer.", "No comment.", "I won't be answering that.", "My instructions do not let me answer that."]
    sound = ["I cannot stress enough that the boiler must be vented first.", "There is no information loss, because the code is lossless.", "The request was denied by the council in 1911.", "It is not possible to divide by zero in this field.", "No answer was found for centuries, until Wiles proved it in 1994.", "I am not able to walk through walls, but neutrinos are."]
    assert all(map(pair_defects.is_refusal, declining)) and not any(map(pair_defects.is_refusal, sound))


@pytest.mark.parametrize(
    "passage, broken",
    [
        ("This is a <b>bold claim that ends.", True), ("<ul><li>One item.<li>Two items.", True), ("<ul><li>One.</li><li>Two.</li></ul>", False), ("<p>Fine.<p>Also fine.", False), ("x <y> and done.", False), ("<b>Done.</b>", False),
        ("Steps:\n1. First thing.\n2. Second thing.\n3. Third", True), ("Steps:\n1. First\n2. Second\n3. Third", False), ("Steps:\n- one\n  - deeper\n  - deeper too\n-", True), ("Steps:\n- one\n- two of the", True),
    ],
)
def test_markup_and_lists(passage, broken):
    assert pair_defects.is_truncated(passage) == broken


def test_defects_of_long_passages():
    query = "Who met the old council?"
    assert pair_defects.is_copy(query, f"{query} " * 60) and pair_defects.is_copy(query, f"You asked: {query * 9}")
    assert not pair_defects.is_copy(query, f"{query} " * 60 + "The mayor.")
    for blank in ("." * 900, "- " * 500, "\u2014 \u2026" * 300):
        assert pair_defects.is_empty(blank) and not pair_defects.is_empty(blank + " Nobody.")
    refusal = "I'm sorry, but I can't help with that. " + "Let me know if you have other questions. " * 30
    assert pair_defects.is_refusal(refusal) and not pair_defects.is_refusal(refusal + "The council met in the hall.")


def test_defect_table(spark, common):
    rows = [(1, "q", None), (1, "q", None), (2, "q", "A sound answer."), (3, None, "x " * 200_000 + "."), (None, "q", None)]
    df = spark.createDataFrame(rows, "pair_id long, query string, passage string").withColumn("defect", F.lit("clash"))
    assert [(r.pair_id, r.defect) for r in pair_defects.find_defects(df, common).where("pair_id is not null").collect()] == [(1, "empty")]
    assert pair_defects.find_defects(df.where("false"), common).count() == 0


# -- 7 and 8


DOCUMENTS = "doc_id long, text string, source string"


def test_packing(spark):
    rng = random.Random(11)
    rows = [(i, "word " * rng.randrange(0, 90), "s") for i in range(400)] + [(1000, "long " * 1000, "s"), (1001, None, "s"), (1002, "", "s"), (None, "x", "s"), (0, "dup", "s")]
    docs = spark.createDataFrame(rows[:-1] + rows[:3], DOCUMENTS).withColumn("window", F.lit(1))
    caps = spark.createDataFrame([("small", 64), ("big", 300), (None, 5), ("none", 0)], "container string, capacity_tokens int")
    out = packing.pack(docs, caps, stream_tokens=5000).collect()
    by = {}
    for r in out:
        by.setdefault((r.container, r.stream, r.window), []).append(r)
    cap = {"small": 64, "big": 300}
    for (c, _, _), items in by.items():
        items.sort(key=lambda r: r.start)
        at = 0
        for r in items:
            assert r.start == at
            at += r.tokens
        assert at <= cap[c]
    for c in cap:
        whole = {}
        for r in out:
            if r.container == c:
                whole.setdefault(r.doc_id, []).append(r)
        assert all(len(v) == 1 or sum(x.tokens for x in v) > cap[c] for v in whole.values())
        assert 1001 not in whole and 1002 not in whole and sum(x.tokens for x in whole[1000]) >= 1000
        used = sum(r.tokens for r in out if r.container == c)
        assert used / (cap[c] * sum(1 for k in by if k[0] == c)) > 0.9
    assert packing.pack(docs.where("false"), caps).count() == 0 == packing.pack(docs, caps.where("false")).count()


def test_sum_of_squares_choice():
    p = packing.Packer(10)
    assert [p.place(s) for s in (6, 6, 4)] == [(0, 0), (1, 0), (1, 6)]
    rng = random.Random(12)
    big = packing.Packer(100)
    sizes = [rng.randrange(5, 60) for _ in range(5000)]
    for s in sizes:
        big.place(s)
    assert sum(sizes) / (100 * big.n) > 0.98


def test_mixing(spark):
    rng = random.Random(13)
    rows = [(i, "word " * rng.randrange(20, 60), ("Big", "small-one", "SMALL_ONE ", "other", None)[i % 5]) for i in range(2000)] + [(5000, "long " * 30_000, "big"), (5001, None, "big"), (None, "x", "big")]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.draw(docs.union(docs.limit(50)), targets, total_tokens=20_000)
    got = {r.source: r for r in shares.collect()}
    assert got["absent"].share == 0 and abs(got["big"].share - 0.5 / 0.9) < 0.01 and abs(got["small_one"].share - 0.4 / 0.9) < 0.01
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= 3 for r in rows) and all(r.repeats == 1 for r in rows if r.source == "big")
    assert sum(r.repeats * r.tokens for r in rows) == sum(r.drawn_tokens for r in got.values()) and all(r.drawn_tokens <= r.budget + 1 for r in got.values())
    empty, none = mixing.draw(docs.where("false"), targets)
    assert empty.count() == 0 and {r.drawn_tokens for r in none.collect()} == {0}


# -- 9


@pytest.mark.parametrize(
    "text, kind",
    [
        (None, "junk"), ("", "junk"), (" \n ", "junk"), ("....", "junk"), ("00", "junk"), ("ab" * 30 + "....0", "junk"), ("%$#@ &*( ~~ ■■ ▒▒ §§ {} []", "junk"), ("Ã©Ã¨ b�n l� r�v� Ã©tÃ© Ã¨", "junk"), ("word " * 200, "junk"), ("var a=function(e){return e.b[1]||0};\n" * 5, "junk"),
        ("- one thing\n- another thing\n- a third thing", "list"), ("1. the first\n2. the second\n3. the third", "list"), ("1.1 Intro ........ 3\n1.2 More ........ 7", "list"), ("Lead in to the list.\n" + "\n".join(f"[x] item {i}" for i in range(9)), "list"),
        ("a,b,c\n" + "\n".join(f"x{i},{i},{i}.5" for i in range(6)), "table"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "table"), ("1 2.5 3\n4 5.5 6\n7 8.5 9", "table"), ("name\tage\nann\t3\nbob\t5", "table"),
        ("The mayor of the town is in the hall and the clerk is in the yard. It is late.", "prose"), ("The mayor of the town is in the hall and the clerk is near to the yard of the mill. It is late in the day.\n- one\n- two", "prose"), ("The hall is in the town. " * 8000, "prose"),
    ],
)
def test_kinds(spark, common, text, kind):
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = quality.quality_statistics(df, common).collect()
    assert [r.kind for r in got] == [kind, kind] and (got[0].reason is None) == (kind == "prose")


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Table 17. The number of the boats in the old harbour of the town", "table"), ("The introduction to the methods of the old town . . . . . . . . 12", "item"),
        ("$12.50 $13.75 $14.20 $15.90 $16.10 $17.35 $18.45 $19.99 $20.05", "table"), ("The council of the town met in the hall and spoke of the harbour.", "prose"),
    ],
)
def test_kinds_of_long_lines(line, kind):
    assert len(line) >= 48 and quality.line_kind(line, frozenset(["the", "of", "in", "and", "to"])) == kind


def test_published_rules(spark, common):
    """Every rule that fails is recorded, whatever the kind."""
    rows = [(1, "The mayor of the town is in the hall and the clerk is with him. " * 8), (2, "- a #\n- b ...\n- c …"), (3, None), (4, "Short and good.")]
    got = {r.doc_id: (r.kind, set(r.failed)) for r in quality.quality_statistics(spark.createDataFrame(rows, "doc_id long, text string"), common).collect()}
    assert got[1] == ("prose", set()) and got[4] == ("prose", {"gopher_words_50_to_100000", "gopher_two_stop_words", "fineweb_short_lines_0.67"})
    assert got[2][0] == "list" and {"gopher_bullet_lines_0.9", "gopher_ellipsis_lines_0.3", "gopher_symbols_to_words_0.1", "gopher_mean_word_length_3_to_10"} <= got[2][1]
    assert got[3][0] == "junk" and "gopher_words_50_to_100000" in got[3][1] and set().union(*(f for _, f in got.values())) <= set(quality.PUBLISHED)


def test_lines_together_and_alone(common):
    """The kinds of all lines at once are those of each line alone, on odd lines too."""
    rng = random.Random(16)
    bits = ["the", "of", "1", "12.5", "$3", "50%", ", ", "; ", ",", ";", " | ", "|", "\t", "  ", " ", "...", ". . . .", "-", "•", "1.", "(a)", "x", "Table 3", "{", "}", "=>", "f(x);", " > ", "»", "word", "Überall", "№", "\u00a0", "\u2003", "٣", "²", "'s", "!", "…", "def ", "<b>", "[x]"]
    lines = [x for x in ("".join(rng.choices(bits, k=rng.randint(1, 14))).strip() for _ in range(4000)) if x]
    known = frozenset(["the", "of", "word"])
    assert quality.line_kinds(pa.array(lines, pa.large_string()), known).tolist() == [quality.line_kind(x, known) for x in lines]


def test_statistics_against_plain(spark, common):
    text = "The mayor is in the hall.\nIt is 12 o'clock.\n- item"
    r = quality.quality_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string"), common).first()
    words = ["The", "mayor", "is", "in", "the", "hall", "It", "is", "o'clock", "item"]
    assert r.n_words == len(words) and r.n_lines == 3 and r.n_chars == len(text) and r.bullet_share == pytest.approx(1 / 3) and r.punct_line_share == pytest.approx(2 / 3)
    assert r.mean_word_length == pytest.approx(sum(map(len, words)) / len(words)) and r.common_share == pytest.approx(5 / 10)
    assert math.isclose(r.list_part + r.table_part + r.code_part + r.prose_part, 1)
    assert quality.quality_statistics(spark.createDataFrame([], "doc_id long, text string"), common).count() == 0
