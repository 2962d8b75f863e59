"""The core queries by name: (spark, folder of tables) -> DataFrame. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.functions import vectors as vx
from pagewright.operators import analytics, chunks, embed, headers, index, pairs, reduce, search, sections, similarity, training
from pagewright.plans.pipeline import pages_to_chunks
from pagewright.session import cut, scratch
from pagewright.sources import files
from pagewright.streaming.ingest import windowed_timing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Chunk sizes of the queries; small, so that sections give several chunks.
SIZES = {"max_tokens": 96, "overlap_tokens": 16, "min_tokens": 32}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def pages(s: SparkSession, d: str) -> DataFrame:
    """Every page once, its text normalised."""
    p = table(s, d, "pdf_pages").select("page_id", "doc_id", "page_number", "raw_text").dropDuplicates(["page_id"])
    return p.select("page_id", "doc_id", "page_number", tx.normalize_text(F.col("raw_text")).alias("cleaned_text")).withColumn("line_list", tx.split_lines(F.col("cleaned_text")))


def doc_sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_sections").dropDuplicates(["doc_id", "section_idx"])


def section_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_sections(doc_sections(s, d), **SIZES)


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def asked(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(s, d).where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id")


def vector_pairs(s: SparkSession, d: str) -> DataFrame:
    """Even ids are anchors, the next odd ids their positives."""
    v = vectors(s, d)
    a = v.where("row_id % 2 = 0").select((F.col("row_id") / 2).cast("long").alias("pair_id"), F.col("embedding").alias("anchor"))
    p = v.where("row_id % 2 = 1").select(((F.col("row_id") - 1) / 2).cast("long").alias("pair_id"), F.col("embedding").alias("positive"))
    return a.join(p, "pair_id")


def timing(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("function_name"), F.col("value").alias("duration"), "ts")


# -- text and documents


@query
def normalize_text(s, d):
    return pages(s, d).select("page_id", F.col("cleaned_text").alias("text"))


@query
def split_lines(s, d):
    return pages(s, d).select("page_id", F.posexplode("line_list").alias("pos", "line"))


@query
def heading_score(s, d):
    return pages(s, d).select("page_id", F.posexplode("line_list").alias("pos", "line")).select("page_id", "pos", F.round(tx.heading_score(F.col("line")), 6).alias("score"))


@query
def detect_headings(s, d):
    return sections.detect_headings(sections.numbered_lines(pages(s, d))).select("doc_id", "page_number", "pos", "line", F.round("score", 6).alias("score"))


@query
def header_footer_candidates(s, d):
    return headers.edge_counts(pages(s, d))


@query
def strip_headers_footers(s, d):
    return headers.strip_headers_footers(pages(s, d)).select("page_id", "cleaned_text")


@query
def strip_repeated_only(s, d):
    """With the sparing of short documents and a lower threshold."""
    return headers.strip_headers_footers(pages(s, d), threshold=0.3, min_repeat=2).select("page_id", "cleaned_text")


@query
def build_sections(s, d):
    return sections.build_sections(pages(s, d))


@query
def page_sections_no_headings(s, d):
    """Documents that give a section a page, for no line is a heading at this score."""
    return sections.build_sections(pages(s, d), min_score=0.75).where("section_id like 'sec_page%' or section_id = 'sec_001' and title = 'Document'")


@query
def split_sentences(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query
def pack_chunks(s, d):
    packed = doc_sections(s, d).select("doc_id", "section_idx", chunks.pack_column(tx.split_sentences(F.col("text")), **SIZES).alias("c"))
    return packed.select("doc_id", "section_idx", F.posexplode("c").alias("pos", "c")).select("doc_id", "section_idx", "pos", F.col("c.text").alias("text"), F.col("c.tokens").alias("tokens"))


@query
def chunk_table(s, d):
    return section_chunks(s, d)


@query
def noise_filter(s, d):
    """Lines with too few letters and digits."""
    return pages(s, d).select("page_id", F.posexplode("line_list").alias("pos", "line")).where(tx.alnum_ratio(F.col("line")) < F.lit(0.6))


@query
def chunk_stats(s, d):
    """Pages to cleaned pages to sections to chunks to one row of statistics."""
    stripped = headers.strip_headers_footers(cut(pages(s, d)), min_repeat=2)
    sec = cut(sections.build_sections(stripped))
    n_pages = table(s, d, "pdf_pages").agg(F.count_distinct("page_id").alias("np"))
    counts = n_pages.crossJoin(sec.agg(F.count("*").alias("ns")))
    made = chunks.chunk_stats(chunks.chunk_sections(sec, **SIZES), 0, 0).drop("num_pages", "num_sections")
    return counts.crossJoin(made).select(F.col("np").alias("num_pages"), F.col("ns").alias("num_sections"), *made.columns)


@query
def pipeline_chunks(s, d):
    """The composed plan over raw pages; agrees with the steps one by one."""
    raw = table(s, d, "pdf_pages").dropDuplicates(["page_id"]).select("doc_id", "page_number", "raw_text")
    return pages_to_chunks(raw, **SIZES, min_repeat=2).select("chunk_id", "token_count", "char_count", "text")


@query
def chunk_describe(s, d):
    t = section_chunks(s, d)
    q = F.percentile("token_count", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.agg(F.count("token_count").alias("count"), F.round(F.avg("token_count"), 6).alias("mean"), F.round(F.stddev_samp("token_count"), 6).alias("std"), F.min("token_count").alias("min"), q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"), F.max("token_count").alias("max"))


@query
def chunk_distincts(s, d):
    return table(s, d, "chunk_embeddings").agg(F.count_distinct("section_id").alias("sections"), F.count_distinct("chunk_id").alias("chunks"), F.min("page_start").alias("first_page"), F.max("page_start").alias("last_page"))


@query
def file_stems(s, d):
    return table(s, d, "doc_sections").select("source_pdf").distinct().select("source_pdf", tx.file_stem(F.col("source_pdf")).alias("stem"))


@query
def non_empty_pages(s, d):
    return headers.non_empty_pages(table(s, d, "pdf_pages").select("page_id", "raw_text").dropDuplicates(["page_id"])).select("page_id")


# -- analytics


@query
def timing_breakdown(s, d):
    return analytics.timing_breakdown(timing(s, d))


@query
def timing_extremes(s, d):
    return analytics.timing_extremes(timing(s, d)).select(F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "longest", "slowest")


@query
def events_datetime(s, d):
    """Epoch seconds to a timestamp's parts and name stamp."""
    at = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")))
    return table(s, d, "events").select("event_id", F.date_format(at, "yyyyMMdd_HHmmss").alias("stamp"))


@query
def windowed_events(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_timing(e, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def loss_improvement(s, d):
    """Daily means of the event values stand in for a loss log."""
    days = table(s, d, "events").groupBy(F.datediff("ts", F.lit("2020-01-01")).alias("epoch")).agg(F.avg("value").alias("loss"))
    return analytics.loss_improvement(days).select(*[F.round(c, 6).alias(c) for c in ("first_loss", "last_loss", "improvement", "improvement_pct")])


@query
def parameter_counts(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("numel"), (F.col("p_partkey") % 10 == 0).alias("trainable"))
    return analytics.parameter_counts(p).withColumn("percent", F.round("percent", 6))


# -- pairs and questions


@query
def pair_aliases(s, d):
    p = table(s, d, "pairs_df").select("pair_id", "query", "passage").dropDuplicates(["pair_id"])
    return pairs.resolve_pair_columns(p, ("query", "passage"))


@query
def validate_pairs(s, d):
    return pairs.validate_pairs(pair_aliases(s, d))


@query
def key_terms(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.key_terms(F.col("text"))).alias("pos", "term"))


@query
def heuristic_questions(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.heuristic_questions(F.col("text"), 6)).alias("pos", "question"))


@query
def statement_to_question(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.long_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "section_idx", "pos", tx.statement_to_question(F.col("sentence")).alias("question"))


@query
def marked_questions(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.marked_questions(F.col("text"))).alias("pos", "question"))


@query
def parse_questions(s, d):
    """Model answers are played by queries as JSON lists, numbered items or plain text, by pair_id."""
    p = table(s, d, "pairs_df").select("pair_id", "query", "section_title").dropDuplicates(["pair_id"])
    answer = F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("Sure: "), F.to_json(F.array("query", F.lower("query"), F.lit("Please go on?"))))).when(F.col("pair_id") % 3 == 1, F.concat(F.lit("1. "), "query", F.lit("\n2) What is the rest of it?\n- "), "query")).otherwise(F.concat("query", F.lit(" Can you say more?")))
    return p.select("pair_id", F.posexplode(tx.parse_questions(answer, 3)).alias("pos", "question"))


@query
def line_questions(s, d):
    return doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(tx.line_questions(F.col("text"))).alias("pos", "question"))


@query
def prompts(s, d):
    """What a model would be asked for each section."""
    asked = tx.prompt("Read this:\n%s\nQuestions:", F.col("text"))
    return doc_sections(s, d).where("text is not null").select("doc_id", "section_idx", F.md5(asked).alias("prompt"))


@query
def build_pairs(s, d):
    c = section_chunks(s, d)
    return pairs.generate_pairs(c, 3).select("chunk_id", "query", "passage", "doc_id", "token_count", "char_count")


@query
def questions_per_chunk(s, d):
    p = table(s, d, "pairs_df").dropDuplicates(["pair_id"])
    return p.agg(F.round(F.try_divide(F.count("*"), F.count_distinct("chunk_id")), 6).alias("avg_questions"))


@query
def grouped_split(s, d):
    p = table(s, d, "pairs_df").select("pair_id", "chunk_id").dropDuplicates(["pair_id"])
    return pairs.grouped_split(p).select("pair_id", "split_name")


@query
def split_counts(s, d):
    p = table(s, d, "pairs_df").select("pair_id", "chunk_id").dropDuplicates(["pair_id"])
    return pairs.split_counts(pairs.grouped_split(p))


@query
def split_leak_check(s, d):
    """Of the delivered splits: groups that stand in more than one."""
    p = table(s, d, "pairs_df").select("pair_id", "chunk_id", "split_name").dropDuplicates(["pair_id"])
    return pairs.split_leaks(p)


@query
def union_roles(s, d):
    p = table(s, d, "pairs_df").select("pair_id", "query", "passage").dropDuplicates(["pair_id"])
    return p.select("pair_id", F.lit("anchor").alias("role"), F.col("query").alias("text")).unionByName(p.select("pair_id", F.lit("positive").alias("role"), F.col("passage").alias("text")))


# -- vectors and retrieval


@query
def unit_norm_check(s, d):
    return vectors(s, d).agg(F.bool_and(vx.is_unit(F.col("embedding"))).alias("all_unit"), F.count_if(vx.is_unit(F.col("embedding"))).alias("n_unit"))


@query
def l2_normalize(s, d):
    """Of the vectors doubled, so that there is something to scale."""
    v = vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x: x * 2 + 0.01))
    return v.select("row_id", F.posexplode(vx.l2_normalize(F.col("embedding"))).alias("i", "x")).select("row_id", "i", F.round("x", 6).alias("x"))


@query
def mean_pool(s, d):
    v = vectors(s, d).withColumn("mask", F.when(F.col("row_id") % 5 == 0, 0).otherwise(1))
    return embed.mean_pool(v, "label", mask="mask").select("label", "i", F.round("value", 6).alias("value"))


@query
def similarity_two_sets(s, d):
    return similarity.similarities(asked(s, d), vectors(s, d)).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"))


#: Columns that a matrix may have at most; beyond it, similarity_two_sets is the same in long form.
PIVOT_COLUMNS = 4096


@query
def similarity_pivot(s, d):
    """The labelled matrix view of the query set with itself, a column for each of its ids."""
    q = asked(s, d)
    ids = sorted(r.query_id for r in q.select("query_id").distinct().limit(PIVOT_COLUMNS + 1).collect())
    if len(ids) > PIVOT_COLUMNS:
        raise ValueError(f"more than {PIVOT_COLUMNS} vectors to pivot over; similarity_two_sets gives them in long form")
    m = similarity.similarities(q, q.withColumnRenamed("query_id", "row_id"))
    return m.groupBy("query_id").pivot("row_id", ids).agg(F.round(F.first("similarity"), 3)).select("query_id", *[F.col(str(i)).alias(f"s{i}") for i in ids])


@query
def rank_positives(s, d):
    return similarity.ranked(similarity.similarities(asked(s, d), vectors(s, d).where("row_id % 2 = 1"))).select("query_id", "row_id", "rank")


@query
def accuracy_and_mrr(s, d):
    scores = similarity.similarities(asked(s, d), vectors(s, d).where("row_id % 2 = 1"))
    return similarity.accuracy_and_mrr(similarity.own_ranks(scores, F.col("row_id") == F.col("query_id") + 1)).select(F.round("accuracy", 6).alias("accuracy"), F.round("mrr", 6).alias("mrr"))


@query
def ranking_listing(s, d):
    r = similarity.ranked(similarity.similarities(asked(s, d), vectors(s, d), k=10))
    return r.select("query_id", "row_id", "rank", (F.col("row_id") == F.col("query_id")).alias("is_match"))


@query
def retrieve_top_k(s, d):
    r = similarity.ranked(similarity.similarities(asked(s, d), vectors(s, d), k=5, not_self=True))
    return r.select("query_id", "row_id", "rank", F.round("similarity", 6).alias("similarity"))


@query
def knn_cosine_distance(s, d):
    scaled = vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    r = index.build_index("knn")(asked(s, d), scaled, k=10)
    return r.select("query_id", "row_id", "rank", F.round("distance", 6).alias("distance"))


@query
def evaluate_retrieval(s, d):
    """A row is relevant to a query of the same label."""
    q, v = asked(s, d), vectors(s, d)
    top = similarity.ranked(similarity.similarities(q, v, k=5, not_self=True))
    relevant = q.select("query_id", "label").join(v.select("row_id", "label"), "label").where("query_id <> row_id").select("query_id", "row_id")
    return similarity.evaluate_retrieval(top, q, relevant).select(*[F.round(c, 6).alias(c) for c in ("precision_at_1", "precision_at_5", "mrr")])


@query
def hard_negatives(s, d):
    scores = similarity.similarities(asked(s, d), vectors(s, d), least=0.2)
    return similarity.hard_negatives(scores, 0.2).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"))


@query
def mine_hard_negatives(s, d):
    """Per query the three most similar rows of another label, as one row."""
    top = similarity.ranked(similarity.similarities(asked(s, d), vectors(s, d), k=3, unlike="label"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row_id"))), lambda x: x["row_id"].cast("string")), ",").alias("hard_negatives"))


@query
def hash_embedding(s, d):
    t = doc_sections(s, d).select("doc_id", "section_idx", F.posexplode(embed.hash_embedding(F.col("text"))).alias("i", "x"))
    return t.where("x <> 0").select("doc_id", "section_idx", "i", F.round("x", 6).alias("x"))


@query
def search_batch_hits(s, d):
    """The five most similar of all sections, ranked, for the queries of the pairs whose id is divisible by 100, by the offline embedder; ties by row_id."""
    p = table(s, d, "pairs_df").where("pair_id % 100 = 0").select("pair_id", "query").dropDuplicates(["pair_id"])
    q = p.select(F.col("pair_id").alias("query_id"), embed.hash_embedding(F.col("query")).alias("embedding"))
    r = doc_sections(s, d).select(F.format_string("%s/%03d", "doc_id", "section_idx").alias("row_id"), embed.hash_embedding(F.col("text")).alias("embedding"))
    hits = similarity.ranked(similarity.similarities(q, r, k=5, digits=9))
    return hits.select("query_id", "row_id", "rank", F.round("similarity", 6).alias("similarity"))


@query
def search_batch(s, d):
    """Of search_batch_hits the similarity of the first hit, which is what its SQL gives."""
    return search_batch_hits(s, d).where("rank = 1").select("query_id", "similarity")


@query
def ivf_top_k(s, d):
    return index.ivf_top_k(asked(s, d), vectors(s, d), k=5).select("query_id", "row_id", "rank", F.round("similarity", 6).alias("similarity"))


@query
def pca_2d(s, d):
    return reduce.pca(vectors(s, d), "row_id")


@query
def tsne_2d(s, d):
    """A picture of at most 500 vectors, by nature of the method."""
    return reduce.tsne_sample(vectors(s, d), "row_id", max_points=500)


@query
def plot_table(s, d):
    p = reduce.pca(vectors(s, d), "row_id").select((F.col("row_id") / 2).cast("long").alias("pair"), F.when(F.col("row_id") % 2 == 0, "anchor").otherwise("positive").alias("role"), "x0", "x1")
    return reduce.plot_table(p, "pair", "role")


@query
def batch_losses(s, d):
    b = training.batch_numbers(vector_pairs(s, d), 16)
    return training.contrastive_losses(b, 0.5).select("batch", F.round("loss", 6).alias("loss"))


@query
def epoch_loss(s, d):
    return training.epoch_loss(training.contrastive_losses(training.batch_numbers(vector_pairs(s, d), 16), 0.5)).select(F.round("epoch_loss", 6).alias("epoch_loss"))


@query
def adapter_training(s, d):
    """(epoch, loss) of a small adapter."""
    config = training.AdapterConfig(r=4, epochs=3, batch_size=16, learning_rate=5e-3)
    losses, _ = training.train_adapter(vector_pairs(s, d), config, steps_per_epoch=2)
    return s.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query
def adapter_first_loss(s, d):
    """The loss of the first epoch in one step over batches in order, before the adapter has moved: that of the bare vectors."""
    config = training.AdapterConfig(r=2, epochs=1, batch_size=16, temperature=0.5, lora_dropout=0.0)
    losses, _ = training.train_adapter(vector_pairs(s, d), config, steps_per_epoch=1, sequential=True)
    return s.createDataFrame([(round(losses[0], 6),)], "loss double")


#: A small adapter of fixed values over 64 dimensions, for apply_adapter and its twin.
FIXED_ADAPTER = {"down": [[((i + 2) * (j + 1) % 7 - 3) / 10 for j in range(64)] for i in range(2)], "up": [[((i + 3) * (j + 1) % 5 - 2) / 10 for i in range(2)] for j in range(64)]}
FIXED_SETTINGS = {"r": 2, "lora_alpha": 4}


@query
def apply_adapter(s, d):
    """Every vector through an adapter that was saved and loaded again."""
    path = files.save_adapter(s, scratch(s, "adapter"), FIXED_ADAPTER, FIXED_SETTINGS)
    matrices, settings = files.load_adapter(s, path)
    t = training.apply_adapter(vectors(s, d), matrices, settings)
    return t.select("row_id", F.posexplode("adapted").alias("i", "x")).select("row_id", "i", F.round("x", 6).alias("x"))


@query
def batch_tokens(s, d):
    """Tokens of queries and passages in batches of 64, cut at 128 and padded within the batch."""
    p = table(s, d, "pairs_df").select("pair_id", F.col("query").alias("anchor"), F.col("passage").alias("positive")).dropDuplicates(["pair_id"])
    t = training.batch_tokens(training.batch_numbers(p, 64))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return t.select("batch", "pair_id", total("anchor_mask").alias("n_anchor"), F.size("anchor_tokens").alias("anchor_width"), total("positive_mask").alias("n_positive"), F.size("positive_tokens").alias("positive_width"))


@query
def search_documents(s, d):
    """The five best sections with their texts, by the search operator, for the queries of the pairs whose id is divisible by 100."""
    q = table(s, d, "pairs_df").where("pair_id % 100 = 0").select(F.col("pair_id").alias("query_id"), "query").dropDuplicates(["query_id"])
    r = doc_sections(s, d).select(F.format_string("%s/%03d", "doc_id", "section_idx").alias("row_id"), F.col("text").alias("document"))
    hits = search.search_batch(q, r, 5, digits=9)
    return hits.select("query_id", "rank", "row_id", F.round("similarity", 6).alias("similarity"), F.md5("document").alias("document"))


@query
def chunk_lookup(s, d):
    """The first delivered vector row of every chunk that a pair names."""
    rows = table(s, d, "chunk_embeddings").select("chunk_id", "vec_id", "doc_id", "page_start")
    return search.lookup(rows, table(s, d, "pairs_df").select("chunk_id"), "chunk_id", "vec_id")


@query
def index_fallback(s, d):
    """The first index at hand: the optional module is not there, so the exact one."""
    find = index.available_index("module_that_is_not_there:search", "flat")
    return find(asked(s, d), vectors(s, d), k=3).select("query_id", "row_id", "rank")


@query
def ivf_all_cells(s, d):
    """With as many probes as there are cells the approximate index is exact."""
    return index.ivf_top_k(asked(s, d), vectors(s, d), k=5, probes=100).select("query_id", "row_id", "rank", F.round("similarity", 6).alias("similarity"))


@query
def pca_moments(s, d):
    """What must hold of the components whatever their signs: as many rows as vectors, means and covariance of nought, the first no narrower than the second."""
    p = pca_2d(s, d)
    return p.agg(F.count("*").alias("n"), (F.abs(F.avg("x0")) < 1e-6).alias("centred0"), (F.abs(F.avg("x1")) < 1e-6).alias("centred1"), (F.abs(F.covar_pop("x0", "x1")) < 1e-6).alias("uncorrelated"), (F.var_pop("x0") >= F.var_pop("x1")).alias("ordered"))


@query
def plot_roles(s, d):
    """The paired plot's table without its coordinates."""
    return plot_table(s, d).select("pair", "role", "colour")


@query
def scatter_table(s, d):
    """The unpaired plot's table of two raw coordinates."""
    v = vectors(s, d).select("label", F.col("embedding")[0].alias("x0"), F.col("embedding")[1].alias("x1"))
    return reduce.scatter_table(v, "label").select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "marker")


@query
def split_back(s, d):
    """The two roles of union_roles apart again and side by side."""
    a, p = reduce.split_roles(union_roles(s, d))
    return a.withColumnRenamed("text", "anchor").join(p.withColumnRenamed("text", "positive"), "pair_id")


# -- files


@query
def toy_pairs(s, d):
    return files.toy_pairs(s).select("pair_id", "anchor")


@query
def csv_round_trip(s, d):
    """Questions, with quotes and line ends in them, written as CSV and read again; missing cells are empty strings."""
    p = table(s, d, "pairs_df").select("pair_id", "query", "passage").dropDuplicates(["pair_id"])
    path = files.write_csv(p.orderBy("pair_id"), scratch(s, "pairs"))
    got = files.read_csv(s, path, "pair_id bigint, query string, passage string")
    return got.select("pair_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("passage", F.lit("")).alias("passage"))


@query
def read_query_passages(s, d):
    """The same file by the reader that finds the two columns."""
    p = table(s, d, "pairs_df").dropDuplicates(["pair_id"]).select("pair_id", "query", "passage")
    got = files.read_query_passages(s, files.write_csv(p, scratch(s, "pairs")))
    return got.agg(F.count("*").alias("n"), F.sum(F.length("anchor")).alias("anchor_chars"), F.sum(F.length("positive")).alias("positive_chars"))


@query
def timing_log(s, d):
    """Events as a headerless timing log, read again with names and date."""
    e = table(s, d, "events").select("event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    path = scratch(s, "timing")
    e.write.option("header", False).csv(path)
    return files.read_timing(s, path).groupBy("function_name").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("seconds"), F.date_format(F.min("datetime"), "yyyyMMdd_HHmmss").alias("first"))


@query
def losses_csv(s, d):
    """Daily means as a loss log with a header, read again."""
    days = table(s, d, "events").groupBy(F.datediff("ts", F.lit("2020-01-01")).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return files.read_losses(s, files.write_csv(days, scratch(s, "losses")))


@query
def capped_rows(s, d):
    """The caller's own cap on the rows of a file."""
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return files.read_csv(s, files.write_csv(n, scratch(s, "nations")), nrows=7).agg(F.count("*").alias("n"))


@query
def latest_file(s, d):
    """Of files with a timestamp in the name the latest, whatever was written last."""
    base = scratch(s, "logs")
    for stamp in ("20250301_120000", "20260109_182752", "20251231_235959"):
        files.write_text(s, f"{base}/log_{stamp}.csv", "a,1,2\n")
    return s.createDataFrame([(files.latest_file(s, f"{base}/*.csv").rsplit("/", 1)[1],)], "name string")


@query
def saved_chunks(s, d):
    """Chunks saved with their sidecar; the statistics as the sidecar holds them and the rows as the table does."""
    base = scratch(s, "chunks")
    made = cut(section_chunks(s, d))
    paths = files.save_chunks(made, f"{base}/chunks.parquet", SIZES, chunks.chunk_stats(made, 1, 2), "a.pdf", "a")
    side = s.read.option("multiLine", True).json(paths["metadata"])
    n = s.read.parquet(paths["parquet"]).agg(F.count("*").alias("rows"))
    return side.select("pdf_path", "config.max_tokens", "statistics.num_chunks", "statistics.total_tokens").crossJoin(n)


@query
def saved_embeddings(s, d):
    """One table of the metadata that exist and the vectors."""
    rows = table(s, d, "chunk_embeddings").where("embedding is not null").dropDuplicates(["vec_id"])
    path = files.save_embeddings(rows, f"{scratch(s, 'vectors')}/embeddings.parquet")
    return s.read.parquet(path).select("doc_id", "chunk_id", "section_id", "page_start", "token_count", "char_count", F.size("embedding").alias("dim"))


@query
def saved_questions(s, d):
    """Pairs saved whole and by split, as parquet and CSV; rows of each file."""
    p = cut(grouped_split(s, d).withColumn("query", F.lit("q")).withColumn("passage", F.lit("p")))
    paths = files.save_questions(p, scratch(s, "questions") + "/pairs", p.where("split_name = 'train'"), p.where("split_name = 'val'"))
    one = lambda name, df: df.agg(F.lit(name).alias("file"), F.count("*").alias("n"))
    out = one("full_parquet", s.read.parquet(paths["full_parquet"]))
    for name in ("full_csv", "train_csv", "val_csv"):
        out = out.union(one(name, files.read_csv(s, paths[name])))
    return out
