"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MOST_LABELS = 256
MOST_BYTES = 16 << 20


def per_label(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` rows of each label, those whose xxhash64(doc_id, label) is smallest, of the
    MOST_LABELS most frequent labels.

    Counts per label fix a hash bound that leaves about 2 * most rows, so the
    ranking sees a bounded number of rows whatever the table's size."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS).collect()}
    draw = F.pmod(F.xxhash64("doc_id", label), F.lit(1 << 40))
    bound = F.lit(0)
    for value, n in counts.items():
        bound = F.when(F.col(label) == F.lit(value), F.lit(int(min(1.0, (2 * most + 50) / max(n, 1)) * (1 << 40)))).otherwise(bound)
    near = rows.withColumn("draw", draw).where(F.col("draw") <= bound)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("draw", "doc_id"))
    return near.withColumn("nth", rank).where(F.col("nth") <= most).drop("draw", "nth")


def within_bytes(rows: DataFrame, label: str, text: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Of a sample's rows, for each label, as many whole texts as have `most_bytes` bytes together; by a hash of the text."""
    upto = F.sum(F.octet_length(text)).over(Window.partitionBy(label).orderBy(F.xxhash64(text), text).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).drop("upto")
