"""Timing and loss analytics, parameter counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing_breakdown(timing: DataFrame) -> DataFrame:
    """Count, mean, sum, min and max of duration by function, rounded to 3 places, largest sum first."""
    r = lambda c: F.round(c, 3)
    return timing.groupBy("function_name").agg(F.count("duration").alias("count"), r(F.avg("duration")).alias("mean_sec"), r(F.sum("duration")).alias("total_sec"), r(F.min("duration")).alias("min_sec"), r(F.max("duration")).alias("max_sec")).orderBy(F.desc("total_sec"), "function_name")


def timing_extremes(timing: DataFrame) -> DataFrame:
    """One row: total, mean, longest and the name of the longest (ties by name)."""
    return timing.agg(F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.max("duration").alias("longest"), F.max_by("function_name", F.struct("duration", "function_name")).alias("slowest"))


def loss_improvement(losses: DataFrame) -> DataFrame:
    """One row: first and last loss by epoch, the difference and its percentage."""
    both = losses.agg(F.min_by("loss", "epoch").alias("first_loss"), F.max_by("loss", "epoch").alias("last_loss"))
    return both.select("first_loss", "last_loss", (F.col("first_loss") - F.col("last_loss")).alias("improvement"), (100 * F.try_divide(F.col("first_loss") - F.col("last_loss"), F.col("first_loss"))).alias("improvement_pct"))


def parameter_counts(parameters: DataFrame) -> DataFrame:
    """One row: trainable and all parameters and the percentage, 0 without any."""
    both = parameters.agg(F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias("trainable"), F.coalesce(F.sum("numel"), F.lit(0)).alias("total"))
    return both.select("trainable", "total", F.when(F.col("total") > 0, 100.0 * F.col("trainable") / F.col("total")).otherwise(F.lit(0.0)).alias("percent"))


def environment_report(spark) -> DataFrame:
    """(component, version) of what a run depends on; null for optional packages that are not there."""
    from importlib import metadata
    from platform import python_version

    rows = [("python", python_version()), ("spark", spark.version), ("java", spark._jvm.System.getProperty("java.version"))]
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "xxhash", "tiktoken", "regex"):
        try:
            rows.append((name, metadata.version(name)))
        except metadata.PackageNotFoundError:
            rows.append((name, None))
    return spark.createDataFrame(rows, "component string, version string")
