"""Streaming ingestion: new page files and timing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.chunks import chunk_sections
from pagewright.operators.headers import clean_pages
from pagewright.operators.sections import build_sections


def page_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Parquet page files as they arrive; a document's pages must come in one batch, for headers and sections need it whole."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def chunks_from_stream(pages: DataFrame, out: str, checkpoint: str, **chunking) -> StreamingQuery:
    """Each batch cleaned, sectioned, chunked and written under its batch number, so a batch run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_sections(build_sections(clean_pages(batch)), **chunking).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_timing(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows over `ts`, for batch and stream; events later than `late` are dropped by the stream's watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
