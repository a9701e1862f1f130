"""All definitions as Spark DataFrames and as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..operators import digest, grouped, logs, recap, render, reports, structure, text, turns, vectors, weighted
from .tables import staged

TABLES = ("events", "documents", "conversations", "embeddings", "benchmark", "labels", "pages")
DEFINITIONS = {**logs.QUERIES, **turns.QUERIES, **digest.QUERIES, **recap.QUERIES, **text.QUERIES, **render.QUERIES, **reports.QUERIES, **structure.QUERIES}


def _run(definition):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = definition(SPARK)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        if hasattr(definition, "steps"):
            return staged(spark, definition.steps(SPARK), definition.CUTS, logs.query)
        return spark.sql(text)

    return query


def queries() -> dict:
    return {name: _run(x) for name, x in (DEFINITIONS | recap.WHOLE).items()} | grouped.QUERIES | vectors.QUERIES | weighted.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: x(DUCK) for name, x in (DEFINITIONS | recap.WHOLE).items()}
