"""The line rules on a stream of log lines, and windowed counts of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import columns

RULES = columns()


def scored(lines: DataFrame, line: str = "line") -> DataFrame:
    """Redacted, normalized, scored and categorised lines; no state is kept."""
    out = lines.where(~RULES["noise"](line)).withColumn("clean", RULES["redact"](line))
    return out.withColumn("template", RULES["normalize"]("clean")).withColumn("score", RULES["line_score"]("clean")).withColumn("category", RULES["category"]("clean"))


def category_counts(lines: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Lines and score by window and category; state lives until the watermark passes."""
    return scored(lines).withWatermark(time, late).groupBy(F.window(time, window), "category").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
