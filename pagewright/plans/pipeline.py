"""End-to-end plans and their command line."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pagewright.operators.chunks import chunk_sections, chunk_stats
from pagewright.operators.headers import clean_pages
from pagewright.operators.pairs import generate_pairs, grouped_split
from pagewright.operators.questions import QuestionGenerator, get_generator
from pagewright.operators.sections import build_sections
from pagewright.session import cut


def pages_to_chunks(pages: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 128, min_heading_score: float = 0.4, **cleaning) -> DataFrame:
    """Raw pages of any number of documents to the chunk table."""
    return chunk_sections(build_sections(clean_pages(pages, **cleaning), min_heading_score), max_tokens, overlap_tokens, min_tokens)


def chunks_to_pairs(chunks: DataFrame, n: int = 3, val_ratio: float = 0.2, seed: int = 42, generator: QuestionGenerator | None = None) -> DataFrame:
    """Chunks to questions with passages and a split without leaks."""
    made = generate_pairs(chunks, n, (generator or get_generator()).questions)
    return grouped_split(made, val_ratio, seed)


def build_dataset(spark: SparkSession, pdf_path: str, out: str, max_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 128, questions: int = 3, val_ratio: float = 0.2, with_embeddings: bool = True, min_heading_score: float = 0.4, generator: QuestionGenerator | None = None, embed: Callable[[Column], Column] | None = None, strict: bool = True) -> dict[str, str]:
    """PDF files to chunks, vectors, pairs and splits under `out`; returns the paths. `generator` makes the questions (heuristics without one), `embed` the vectors (the hash embedding without one)."""
    from pyspark.sql import functions as F

    from pagewright.operators.embed import hash_embedding
    from pagewright.sources.files import save_chunks, save_embeddings, save_questions
    from pagewright.sources.pdf import read_pdf_pages

    pages = cut(read_pdf_pages(spark, pdf_path, strict=strict))
    sections = cut(build_sections(clean_pages(pages, min_repeat=2), min_heading_score))
    chunks = cut(chunk_sections(sections, max_tokens, overlap_tokens, min_tokens))
    config = {"max_tokens": max_tokens, "overlap_tokens": overlap_tokens, "min_tokens": min_tokens, "min_heading_score": min_heading_score}
    paths = save_chunks(chunks, f"{out}/chunks.parquet", config, chunk_stats(chunks, pages.count(), sections.count()), pdf_path)
    if with_embeddings:
        paths["embeddings"] = save_embeddings(chunks.withColumn("embedding", (embed or hash_embedding)(F.col("text"))), f"{out}/embeddings.parquet")
    pairs = cut(chunks_to_pairs(chunks, questions, val_ratio, generator=generator))
    paths |= save_questions(pairs, f"{out}/pairs", pairs.where("split_name = 'train'"), pairs.where("split_name = 'val'"))
    return paths


def train(spark: SparkSession, csv_path: str | None, out: str, r: int = 16, epochs: int = 10, batch_size: int = 4, rate: float = 2e-4) -> list[float]:
    """Pairs to a saved adapter over the offline embedder's vectors; the toy pairs without a file."""
    from pyspark.sql import functions as F

    from pagewright.operators.embed import hash_embedding
    from pagewright.operators.training import AdapterConfig, train_adapter
    from pagewright.sources.files import read_pairs, save_adapter, toy_pairs

    pairs = read_pairs(spark, csv_path).withColumn("pair_id", F.monotonically_increasing_id()) if csv_path else toy_pairs(spark)
    vectors = pairs.select("pair_id", hash_embedding(F.col("anchor")).alias("anchor"), hash_embedding(F.col("positive")).alias("positive"))
    config = AdapterConfig(r=r, epochs=epochs, batch_size=batch_size, learning_rate=rate)
    losses, matrices = train_adapter(vectors, config)
    save_adapter(spark, out, matrices, config.to_dict())
    return losses


def ratio(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return value


def main(argv: list[str] | None = None) -> None:
    from pagewright.session import build_session

    parser = argparse.ArgumentParser(prog="pagewright")
    sub = parser.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="PDF files to chunks, pairs and splits")
    build.add_argument("pdf_path")
    build.add_argument("--out", required=True)
    for name, default in (("max-tokens", 512), ("overlap-tokens", 64), ("min-tokens", 128), ("questions", 3)):
        build.add_argument(f"--{name}", type=int, default=default)
    build.add_argument("--val-ratio", type=ratio, default=0.2)
    build.add_argument("--min-heading-score", type=float, default=0.4)
    build.add_argument("--no-embeddings", action="store_true")
    fit = sub.add_parser("train", help="pairs to an adapter")
    fit.add_argument("--csv")
    fit.add_argument("--out", required=True)
    fit.add_argument("--rank", type=int, default=16)
    fit.add_argument("--epochs", type=int, default=10)
    fit.add_argument("--batch-size", type=int, default=4)
    fit.add_argument("--rate", type=float, default=2e-4)
    a = parser.parse_args(argv)
    spark = build_session()
    if a.command == "build":
        print(build_dataset(spark, a.pdf_path, a.out, a.max_tokens, a.overlap_tokens, a.min_tokens, a.questions, a.val_ratio, not a.no_embeddings, a.min_heading_score))
    else:
        print(train(spark, a.csv, a.out, a.rank, a.epochs, a.batch_size, a.rate))


if __name__ == "__main__":
    main()
