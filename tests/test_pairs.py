import datetime
import os
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import analytics, pairs, questions
from pagewright.operators.timing import TimeBlock, timed
from pagewright.plans import pipeline
from pagewright.sources import files
from pagewright.sources.pdf import SimplePdfParser, read_pdf_pages
from pagewright.streaming.ingest import chunks_from_stream, page_stream, windowed_timing


def test_aliases(spark):
    df = spark.createDataFrame([("q", None)], "sentence1 string, sentence2 string")
    assert pairs.resolve_pair_columns(df).first().asDict() == {"anchor": "q", "positive": ""}
    with pytest.raises(ValueError, match="other"):
        pairs.resolve_pair_columns(df.select(F.lit(1).alias("other")))


def test_validate(spark):
    got = pairs.validate_pairs(files.toy_pairs(spark)).first()
    assert got.num_pairs == 4 and not got.has_empty and got.avg_anchor_length > 0
    assert pairs.validate_pairs(files.toy_pairs(spark).where("false")).first().asDict() == {"num_pairs": 0, "avg_anchor_length": 0.0, "avg_positive_length": 0.0, "has_empty": False}


@pytest.mark.parametrize("n, ratio, val", [(10, 0.2, 2), (2, 0.3, 1), (1000, 0.2, 200)])
def test_split(spark, n, ratio, val):
    df = spark.createDataFrame([(i, f"c{i % n}") for i in range(3 * n)], "pair_id long, chunk_id string")
    out = pairs.grouped_split(df, ratio)
    assert out.where("split_name = 'val'").select("chunk_id").distinct().count() == val
    assert pairs.split_leaks(out).first().num_leaks == 0 and out.count() == 3 * n


def test_split_errors(spark):
    one = spark.createDataFrame([(1, "c")], "pair_id long, chunk_id string")
    with pytest.raises(ValueError):
        pairs.grouped_split(one)
    with pytest.raises(ValueError):
        pairs.grouped_split(one, 1.5)


def test_generate(spark):
    df = spark.createDataFrame([("Quarry Stone is hard and heavy. Other things stand here too.",), (None,), ("",)], "text string")
    got = pairs.generate_pairs(df, 3)
    assert got.count() == 3 and {r.doc_id for r in got.collect()} == {"unknown"}


def test_generators(spark):
    class Echo:
        def __call__(self, prompts, **settings):
            assert settings == {"max_new_tokens": 100, "temperature": 0.7, "top_p": 0.9, "device": None}
            if any("boom" in p for p in prompts):
                raise RuntimeError("boom")
            return [p + " Who built the old mill?" for p in prompts]

    df = spark.createDataFrame([("some text",), ("boom",)], "text string")
    model = questions.get_generator(Echo)
    got = df.select("text", model.questions(F.col("text"), 2).alias("q")).collect()
    assert {r.text: r.q for r in got} == {"some text": ["Who built the old mill?"], "boom": []}

    def broken():
        raise OSError("no model")

    assert isinstance(questions.get_generator(broken), questions.HeuristicGenerator)
    with pytest.raises(OSError):
        questions.get_generator(broken, fallback=False)


def test_analytics(spark):
    t = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", 5.0, 0.0)], schemas.TIMING)
    assert [r.function_name for r in analytics.timing_breakdown(t).collect()] == ["b", "a"]
    assert analytics.timing_extremes(t).first().slowest == "b"
    assert analytics.loss_improvement(spark.createDataFrame([(1, 4.0), (2, 3.0)], schemas.LOSSES)).first().improvement_pct == 25
    assert analytics.parameter_counts(spark.createDataFrame([("w", 50, True), ("b", 5, False)], schemas.PARAMETERS)).first().percent == pytest.approx(100 * 50 / 55)
    assert analytics.parameter_counts(spark.createDataFrame([], schemas.PARAMETERS)).first().percent == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [("a\nb", 'say "x", y'), ("", "plain")]
    df = spark.createDataFrame(rows, "query string, passage string")
    back = files.read_csv(spark, files.write_csv(df, str(tmp_path / "c")), df.schema)
    assert sorted((r.query or "", r.passage) for r in back.collect()) == sorted(rows)


def test_timing_log(spark, tmp_path):
    path = str(tmp_path / "t" / "timing.csv")

    @timed(path)
    def work():
        return 7

    assert work() == 7
    with pytest.raises(KeyError), TimeBlock("block", path):
        raise KeyError
    got = {r.function_name for r in files.read_timing(spark, path).collect()}
    assert got == {"work", "block"}


def test_latest(spark, tmp_path):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    new, old = files.timestamped_path(str(tmp_path), "x", "csv", at), files.timestamped_path(str(tmp_path), "x", ".csv", at.replace(year=2020))
    for p in (new, old):
        open(p, "w").write("1")
    assert files.latest_file(spark, f"{tmp_path}/*.csv").endswith("x_20240102_030405.csv")
    assert files.latest_file(spark, f"{tmp_path}/*.nothing") is None
    assert not files.timestamped_path(str(tmp_path), "x").endswith(".")


def pdf(pages, flate=False):
    out, kids = [b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"], []
    for i, lines in enumerate(pages):
        body = b"BT /F1 12 Tf " + b" ".join(b"(%s) Tj 0 -14 Td" % x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines) + b" ET"
        data = zlib.compress(body) if flate else body
        kids.append(b"%d 0 R" % (3 + 2 * i))
        out.append(b"%d 0 obj << /Type /Page /MediaBox [0 0 612 792] /Contents %d 0 R >> endobj\n" % (3 + 2 * i, 4 + 2 * i))
        out.append(b"%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (4 + 2 * i, len(data), b"/Filter /FlateDecode" if flate else b"", data))
    out.insert(1, b"2 0 obj << /Type /Pages /Kids [%s] /Count %d >> endobj\n" % (b" ".join(kids), len(pages)))
    return b"".join(out)


@pytest.mark.parametrize("flate", [False, True])
def test_parser(flate):
    got = SimplePdfParser()(pdf([["Hello (x)", "second"], ["Page two"]], flate))
    assert [t for t, *_ in got] == ["Hello (x)\nsecond", "Page two"] and got[0][1:] == (612.0, 792.0)


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(pdf([["One"], ["Two"]]))
    (tmp_path / "bad.pdf").write_bytes(b"rubbish")
    (tmp_path / "blank.pdf").write_bytes(pdf([[""]]))
    got = read_pdf_pages(spark, str(tmp_path)).orderBy("doc_id", "page_number").collect()
    assert [(r.doc_id, r.page_number, r.raw_text) for r in got if r.error is None] == [("good", 1, "One"), ("good", 2, "Two")]
    assert {r.doc_id for r in got if r.error} == {"bad", "blank"}
    with pytest.raises(Exception, match="no text"):
        read_pdf_pages(spark, str(tmp_path / "blank.pdf"), strict=True).collect()


def test_end_to_end(spark, tmp_path):
    lines = lambda p: ["RUNNING HEAD", f"{p} Chapter Of Stones", *[f"Quarry {p} gives stone number {i} to the old mill." for i in range(12)]]
    (tmp_path / "book.pdf").write_bytes(pdf([lines(p) for p in range(1, 4)]))
    paths = pipeline.build_dataset(spark, str(tmp_path / "book.pdf"), str(tmp_path / "out"), 40, 8, 10, 2, 0.3)
    assert {"parquet", "metadata", "embeddings", "full_parquet", "full_csv", "train_csv", "val_csv"} == set(paths)
    full = spark.read.parquet(paths["full_parquet"])
    assert full.count() > 0 and pairs.split_leaks(full).first().num_leaks == 0
    assert os.path.getsize(paths["metadata"]) > 0
    with pytest.raises(SystemExit):
        pipeline.main(["build", "x.pdf", "--out", "y", "--val-ratio", "2"])


def test_train(spark, tmp_path):
    losses = pipeline.train(spark, None, str(tmp_path / "adapter"), r=2, epochs=2, batch_size=2)
    assert len(losses) == 2 and (tmp_path / "adapter" / "adapter_config.json").exists()


def test_stream(spark, tmp_path):
    rows = [("d", i, f"{i} Title Here\nSome words on page {i}.", None, None, {}) for i in (1, 2, 3)]
    spark.createDataFrame(rows, schemas.PAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = chunks_from_stream(page_stream(spark, str(tmp_path / "in"), schemas.PAGES), str(tmp_path / "out"), str(tmp_path / "cp"), max_tokens=20, overlap_tokens=2, min_tokens=2)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    e = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 5), "x", 1.0), (datetime.datetime(2024, 1, 1, 0, 9), "x", 2.0)], "ts timestamp, event_type string, value double")
    assert windowed_timing(e).first().total == 3.0


def test_strict_whatever_is_used(spark, tmp_path):
    """A broken file fails a strict query that uses neither its error nor its text; without strict it gives a row."""
    (tmp_path / "broken.pdf").write_bytes(b"no pdf at all")
    with pytest.raises(Exception, match="broken.pdf"):
        read_pdf_pages(spark, str(tmp_path / "broken.pdf"), strict=True).select("doc_id").count()
        read_pdf_pages(spark, str(tmp_path / "broken.pdf"), strict=True).select("doc_id").collect()
    assert read_pdf_pages(spark, str(tmp_path / "broken.pdf")).first().error


def test_second_parser(spark, tmp_path):
    """Without header and page tree the streams are read in the order of the file."""
    (tmp_path / "torn.pdf").write_bytes(b"junk 5 0 obj << /Length 30 >> stream\nBT (First words) Tj ET\nendstream endobj stream\nBT (second part) Tj ET\nendstream")
    got = read_pdf_pages(spark, str(tmp_path / "torn.pdf"), strict=True).orderBy("page_number").collect()
    assert [r.raw_text for r in got] == ["First words", "second part"]


def test_search_with_documents(spark):
    from pagewright.operators import search

    docs = spark.createDataFrame([("a", "the harbour wall"), ("b", "the old mill"), ("c", None), ("d", "the harbour wall")], "row_id string, document string")
    got = [(r["rank"], r.row_id, r.document) for r in search.search("harbour wall", docs, top_k=3).collect()]
    assert got[:2] == [(1, "a", "the harbour wall"), (2, "d", "the harbour wall")] and got[2][1] in "bc" and len(got) == 3
    many = search.search_batch(spark.createDataFrame([(1, "old mill"), (2, None)], "query_id int, query string"), docs, top_k=1)
    assert {(r.query_id, r.row_id) for r in many.collect()} >= {(1, "b")}
    assert search.search("x", docs.where("false")).count() == 0
    rows = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 1, "other"), (None, 1, "none")], "chunk_id string, n int, text string")
    ids = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "chunk_id string")
    assert [(r.chunk_id, r.n, r.text) for r in search.lookup(rows, ids, "chunk_id", "n").collect()] == [("a", 1, "first")]


def test_indexes_at_hand(spark):
    from pagewright.operators import index

    assert index.available_index("no_module_of_this_name:search") is None
    assert index.available_index("no_module_of_this_name:search", "math:nothing", "flat") is not None
    with pytest.raises(ValueError):
        index.available_index("other")


def test_environment(spark):
    got = {r.component: r.version for r in analytics.environment_report(spark).collect()}
    assert got["spark"] == spark.version and got["pyarrow"]


def test_token_batches(spark):
    from pagewright.operators import training

    df = spark.createDataFrame([(0, 1, "a b c", None), (0, 2, "d", "x y"), (1, 3, "", "z")], "batch int, pair_id int, anchor string, positive string")
    got = {r.pair_id: r for r in training.batch_tokens(df, most=2).collect()}
    assert got[1].anchor_tokens == ["a", "b"] and got[2].anchor_tokens == ["d", ""] and got[2].anchor_mask == [1, 0]
    assert got[1].positive_mask == [0, 0] and got[3].anchor_tokens == [] and got[3].positive_tokens == ["z"]


def test_small_files(spark, tmp_path):
    path = files.write_text(spark, f"file://{tmp_path}/side.json", '{"größe": 1}')
    assert files.read_text(spark, path) == '{"größe": 1}' and not os.path.exists(f"{tmp_path}/side.json.part")
    files.save_adapter(spark, f"file://{tmp_path}/adapter", {"down": [[1.0, 2.0]], "up": [[3.0], [4.0]]}, {"r": 1, "lora_alpha": 2})
    assert files.load_adapter(spark, f"file://{tmp_path}/adapter") == ({"down": [[1.0, 2.0]], "up": [[3.0], [4.0]]}, {"r": 1, "lora_alpha": 2})
    with TimeBlock("step", f"file://{tmp_path}/log"):
        pass
    assert files.read_timing(spark, f"file://{tmp_path}/log").first().function_name == "step"


def test_csv_keeps_white_space(spark, tmp_path):
    df = spark.createDataFrame([(1, "  ahead", "behind \n"), (2, 'a "b"\nc', " ")], "n int, query string, passage string")
    got = files.read_csv(spark, files.write_csv(df, str(tmp_path / "w")), "n int, query string, passage string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
