"""Files in and out: CSV with quoted newlines, latest files, timestamped names, tables with their sidecars."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright import schemas
from pagewright.operators.pairs import resolve_pair_columns

# Four small pairs for trying things out.
TOY_PAIRS = (
    ("How do plants make food?", "Leaves turn light, water and air into sugar."),
    ("What keeps ships afloat?", "A hull floats because it displaces its weight in water."),
    ("Why is the sky blue?", "Air scatters short waves of sunlight more than long ones."),
    ("How is bread made to rise?", "Yeast gives off gas that fills the dough with bubbles."),
)


def toy_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, p) for i, (a, p) in enumerate(TOY_PAIRS)], schemas.PAIRS)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, nrows: int | None = None, header: bool = True) -> DataFrame:
    """CSV whose quoted fields may hold newlines and doubled quotes; `nrows` is the caller's own cap."""
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df if nrows is None else df.limit(nrows)


def read_pairs(spark: SparkSession, path: str, prefer: tuple[str, str] = ("anchor", "positive")) -> DataFrame:
    return resolve_pair_columns(read_csv(spark, path), prefer)


def read_query_passages(spark: SparkSession, path: str) -> DataFrame:
    return read_pairs(spark, path, ("query", "passage"))


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """The headerless timing log with names and `datetime`."""
    return read_csv(spark, path, schemas.TIMING, header=False).withColumn("datetime", F.timestamp_seconds("timestamp"))


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LOSSES)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def timestamp(at: datetime | None = None) -> str:
    return (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def timestamped_path(base: str, name: str, ext: str = "", at: datetime | None = None) -> str:
    """base/name_YYYYmmdd_HHMMSS.ext, no dot without a suffix; a local folder is made, one of a URI comes with the first file in it."""
    if "://" not in base:
        os.makedirs(base, exist_ok=True)
    ext = ext.lstrip(".")
    return f"{base.rstrip('/')}/{name}_{timestamp(at)}" + (f".{ext}" if ext else "")


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file at any path that Spark itself can write to (local, or a URI of a shared store): written beside its place, then moved there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = place.getFileSystem(conf)
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"cannot move {path}.part into place")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of one small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content).decode("utf-8")


def latest_file(spark: SparkSession, glob: str) -> str | None:
    """The file whose name holds the latest timestamp, then the one modified last; None without any."""
    stamp = F.regexp_extract("path", r"(\d{8}_\d{6})[^/]*$", 1)
    try:
        files = spark.read.format("binaryFile").load(glob)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    row = files.select("path", stamp.alias("s"), "modificationTime").agg(F.max_by("path", F.struct("s", "modificationTime", "path")).alias("path")).first()
    return row.path


def save_chunks(chunks: DataFrame, path: str, config: dict, statistics: DataFrame, pdf_path: str = "", doc_id: str = "") -> dict[str, str]:
    """Chunks as parquet and their statistics as an indented JSON file beside it, written last and moved into place."""
    chunks.write.mode("overwrite").parquet(path)
    side = path.rstrip("/") + "_metadata.json"
    body = {"pdf_path": pdf_path, "doc_id": doc_id, "config": config, "statistics": statistics.first().asDict(), "parquet_path": path}
    write_text(chunks.sparkSession, side, json.dumps(body, indent=2, ensure_ascii=False))
    return {"parquet": path, "metadata": side}


def save_questions(pairs: DataFrame, base: str, train: DataFrame | None = None, val: DataFrame | None = None) -> dict[str, str]:
    """The pairs as parquet and CSV, the splits as CSV where given; returns the paths."""
    out = {"full_parquet": f"{base}_full.parquet", "full_csv": write_csv(pairs, f"{base}_full_csv")}
    pairs.write.mode("overwrite").parquet(out["full_parquet"])
    for name, df in (("train", train), ("val", val)):
        if df is not None:
            out[f"{name}_csv"] = write_csv(df, f"{base}_{name}_csv")
    return out


def save_embeddings(df: DataFrame, path: str, vector: str = "embedding") -> str:
    """One table of the metadata that exist and the vectors, so that no row order ties them."""
    order = ("doc_id", "chunk_id", "section_id", "section_title", "page_start", "page_end", "token_count", "char_count", "text")
    df.select(*[c for c in order if c in df.columns], F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)
    return path


def save_adapter(spark: SparkSession, path: str, matrices: dict, config: dict) -> str:
    """Adapter matrices as parquet, the configuration as JSON."""
    rows = [(name, i, [float(x) for x in row]) for name, m in matrices.items() for i, row in enumerate(m)]
    spark.createDataFrame(rows, "name string, row int, values array<double>").write.mode("overwrite").parquet(f"{path}/matrices")
    write_text(spark, f"{path}/adapter_config.json", json.dumps(config, indent=2))
    return path


def load_adapter(spark: SparkSession, path: str) -> tuple[dict[str, list[list[float]]], dict]:
    """(matrices, configuration) as `save_adapter` wrote them; an adapter is a few rows."""
    out: dict[str, list[list[float]]] = {}
    for r in spark.read.parquet(f"{path}/matrices").orderBy("name", "row").collect():
        out.setdefault(r.name, []).append(list(r["values"]))
    return out, json.loads(read_text(spark, f"{path}/adapter_config.json"))
