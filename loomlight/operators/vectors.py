"""Nearest vectors by cosine similarity: every query against every row.

The queries go out in broadcast blocks of bounded size; a task keeps the top
rows of each query only, so no pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship

# Queries of a block, rows compared at once.
BLOCK, ROWS = 4096, 1024
SCALE, NONE = 1_000_000, -(2**31)


def matrices(ids, embeddings) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and unit vectors; vectors with nulls, without id or of no length are left out."""
    found: dict[int, tuple[list, list]] = {}
    for i, e in zip(ids, embeddings):
        if i is not None and e is not None and None not in e:
            v = np.array(e, dtype=np.float64)
            norm = np.sqrt(v @ v)
            if norm > 0:
                at = found.setdefault(len(v), ([], []))
                at[0].append(i)
                at[1].append(v / norm)
    return {n: (np.array(i, dtype=np.int64), np.array(v)) for n, (i, v) in found.items()}


class Top:
    """The k best rows of each query so far, by similarity of six digits and then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best = np.full((len(ids), k), NONE)
        self.rows = np.zeros((len(ids), k), dtype=np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            x = self.vectors @ vectors[some].T
            near = (np.sign(x) * np.floor(np.abs(x) * SCALE + 0.5)).astype(np.int64)
            near[self.ids[:, None] == ids[some][None, :]] = NONE
            # one number for similarity and place by id, so that ties fall to the smaller id
            key = near * ROWS + (ROWS - 1 - np.arange(len(some)))
            k = min(self.k, len(some))
            top = np.argpartition(-key, k - 1, axis=1)[:, :k]
            best = np.concatenate([self.best, np.take_along_axis(near, top, 1)], axis=1)
            rows = np.concatenate([self.rows, ids[some][top]], axis=1)
            first = np.lexsort((rows, -best), axis=1)[:, : self.k]
            self.best, self.rows = np.take_along_axis(best, first, 1), np.take_along_axis(rows, first, 1)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, j = np.nonzero(self.best > NONE)
        return self.ids[q], self.rows[q, j], self.best[q, j] / SCALE


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k rows nearest to each query, itself aside. Both have vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast(matrices([r[0] for r in block], [r[1] for r in block]))

        def scan(batches, sent=sent):
            tops = {n: Top(*m, k) for n, m in sent.value.items()}
            for batch in batches:
                for n, m in matrices(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                    if n in tops:
                        tops[n].add(*m)
            for top in tops.values():
                yield pa.record_batch([pa.array(c) for c in top.table()], names=["query_id", "vec_id", "similarity"])

        part = rows.mapInArrow(scan, "query_id long, vec_id long, similarity double")
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _cosine(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"sim_cosine_topk": _cosine}
