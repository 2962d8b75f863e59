import random

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import chunks, headers, sections
from pagewright.plans.pipeline import pages_to_chunks


def pages(spark, docs):
    rows = [(d, i, "\n".join(lines), "\n".join(lines), lines, {}) for d, ps in docs.items() for i, lines in enumerate(ps, 1)]
    return spark.createDataFrame(rows, schemas.PAGES)


def by_page(df):
    return {(r.doc_id, r.page_number): r.line_list for r in df.collect()}


def test_headers_go(spark):
    doc = [["HEAD", *[f"line {p} {i}" for i in range(6)], "foot"] for p in range(5)]
    out = by_page(headers.strip_headers_footers(pages(spark, {"d": doc})))
    assert all(out["d", p + 1] == [f"line {p} {i}" for i in range(6)] for p in range(5))


def test_short_documents(spark):
    same, two, few = [["a", "b", "c"]] * 5, [["a", "b", "c"], ["d", "e", "f"]], [["a", "b"]] * 5
    df = pages(spark, {"same": same, "two": two, "few": few})
    out = by_page(headers.strip_headers_footers(df))
    assert out["same", 1] == [] and out["two", 1] == [] and out["few", 1] == ["a", "b"]
    assert by_page(headers.strip_headers_footers(df, min_repeat=2))["two", 1] == ["a", "b", "c"]


def test_sections(spark):
    df = pages(spark, {"h": [["preface", "ALPHA", "text"], ["BRAVO", "more"]], "p": [["some words"], ["other words"]], "s": [["just words"]], "e": [[]]})
    out = {(r.doc_id, r.section_id): (r.title, r.text, r.page_start, r.page_end) for r in sections.build_sections(df).collect()}
    assert out == {
        ("h", "sec_000"): ("ALPHA", "ALPHA\ntext", 1, 1), ("h", "sec_001"): ("BRAVO", "BRAVO\nmore", 2, 2),
        ("p", "sec_page_001"): ("Page 1", "some words", 1, 1), ("p", "sec_page_002"): ("Page 2", "other words", 2, 2), ("s", "sec_001"): ("Document", "just words", 1, 1),
    }
    kept = sections.build_sections(df, keep_preamble=True).where("section_id = 'sec_preamble'").first()
    assert kept.text == "preface"


def test_empty(spark):
    none = spark.createDataFrame([], schemas.PAGES)
    assert pages_to_chunks(none).count() == 0
    stats = chunks.chunk_stats(pages_to_chunks(none), 0, 0).first()
    assert (stats.num_chunks, stats.total_tokens, stats.median_tokens) == (0, 0, 0.0)


def test_pack_by_hand():
    got = chunks.pack_sentences(["a b c", "d e", "f g", "h i j k l m n", "o"], 6, 2, 3)
    assert got == ["a b c d e", "d e f g", "f g h i j k l m n", "o"]
    words = lambda n: " ".join("w" * n)
    assert [len(c.split()) for c in chunks.pack_sentences([words(4), words(8), words(3)], 10, 0, 5)] == [12, 3]
    assert chunks.pack_sentences([], 6, 2, 3) == []


def plain_pack(sentences, most, over, least):
    """Written on its own, with indices instead of carried lists."""
    n = [len(s.split()) for s in sentences]
    bounds, a, i = [], 0, 0
    while i < len(sentences):
        if i > a and sum(n[a:i]) + n[i] > most:
            bounds.append((a, i))
            b = i
            while b > a and sum(n[b - 1 : i]) <= over:
                b -= 1
            a = b
        i += 1
        if i - a == 1 and a == i - 1:
            pass
    if a < len(sentences):
        bounds.append((a, len(sentences)))
    out = [" ".join(sentences[a:b]) for a, b in bounds]
    merged, k = [], 0
    while k < len(out):
        if len(out[k].split()) < least and k + 1 < len(out) and len(out[k].split()) + len(out[k + 1].split()) <= 1.2 * most:
            merged.append(out[k] + " " + out[k + 1])
            k += 2
        else:
            merged.append(out[k])
            k += 1
    return merged


@pytest.mark.parametrize("seed", range(30))
def test_pack_against_plain(seed):
    rng = random.Random(seed)
    s = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 40))]
    # a sentence that fits the overlap must not empty the walk: both forms close chunks at the same places
    assert chunks.pack_sentences(s, 12, 4, 6) == plain_pack(s, 12, 4, 6)


def test_chunk_ids_and_noise(spark):
    rows = [("d", 0, "sec_000", "T", 1, 1, 2, "Real words stand here. !!! ??? ***** ------ ///// ((((( )))))  . More real words", None)]
    df = spark.createDataFrame(rows, schemas.SECTIONS)
    out = chunks.chunk_sections(df, 4, 0, 1).collect()
    assert all(r.chunk_id.startswith("d::sec000::chunk") and r.char_count == len(r.text) and r.page_end == 2 for r in out)
    assert not any(set(r.text) <= set("!?*-/() .") for r in out)


def test_extra_columns(spark):
    df = pages(spark, {"h": [["ALPHA", "text"]]}).withColumn("zone", F.lit(1)).withColumn("_n", F.lit(2))
    assert headers.strip_headers_footers(df).columns == df.columns


def test_sections_of_a_long_document(spark):
    """More pages than a range of the prefix sums holds, headings on few of them, pages without lines between."""
    doc = [[f"BRAVO {p}" if p % 700 == 5 else f"line {p}", "more"] if p % 3 else [] for p in range(2200)]
    out = sections.build_sections(pages(spark, {"long": doc, "bare": [["just words"]] * 1500})).orderBy("doc_id", "section_idx").collect()
    long = [r for r in out if r.doc_id == "long"]
    heads = [p for p in range(2200) if p % 700 == 5 and p % 3]
    assert [r.title for r in long] == [f"BRAVO {p}" for p in heads] and [r.section_idx for r in long] == list(range(len(heads)))
    assert [r.page_start for r in long] == [p + 1 for p in heads] and sum(r.text.count("more") for r in long) == sum(1 for p in range(heads[0], 2200) if p % 3)
    assert [r.section_idx for r in out if r.doc_id == "bare"] == list(range(1500))
