"""Shared folder, written tables and tables of the driver's folder layout."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import shipping
from ..plans.tables import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(col) -> F.Column:
    """crc32 of an id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def spread(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CARRIED = "input_row"
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def schema_of(documents: DataFrame, ddl: str, carry: bool) -> T.StructType:
    """ddl, and the whole input row as a struct where it is carried along."""
    out = T._parse_datatype_string(ddl)
    return T.StructType([*out.fields, T.StructField(CARRIED, documents.schema)]) if carry else out


def carried(carry: bool, columns: list[str] | None = None) -> list:
    """The input row as a struct, or these columns of it."""
    every = ["*"] if columns is None else [F.col(f"`{c}`") for c in columns]
    return [(F.struct(*every) if every else F.struct(F.lit(0).alias("none"))).alias(CARRIED)] if carry else []


def carried_once(documents: DataFrame, text: str, carry: bool) -> list:
    """The input row as a struct, without the text where that goes along as `text` as it is; `input_rows` puts it back."""
    names = documents.columns
    plain = text in names and "`" not in "".join(names) and len({c.lower() for c in names}) == len(names)
    if not (plain and documents.schema[text].dataType == T.StringType()):
        return carried(carry)
    return carried(carry, [c for c in names if c != text])


def input_rows(batch: pa.RecordBatch, names: list[str], text: str) -> pa.Array:
    """The input rows, with these columns, of a batch that has them by `carried_once`."""
    rows = batch.column(CARRIED)
    if rows.type.get_field_index(text) >= 0 or text not in names:
        return rows
    columns = [batch.column("text") if c == text else rows.field(c) for c in names]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(c, x.type) for c, x in zip(names, columns)])


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers. Arrow batches of whole texts hold
    BATCH_ROWS rows unless the session sets a number."""
    shipping.ship(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
