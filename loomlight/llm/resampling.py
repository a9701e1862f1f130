"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams are counted: the raw
one over all documents, the target one over a bounded sample of documents
labelled good. A document's log importance weight is the log ratio of its
chances under target and raw, summed over its features; a Gumbel draw fixed by
the document's id is added, and the k largest sums are kept, which samples k
documents without replacement in proportion to their weights. Long documents
have larger weights of either sign, as that ratio has; `per_feature` takes the
mean ratio times that number instead. The k-th sum is found by counting in ranges.

Defined results: null and wordless texts have weight 0 and take part in the
draw; equal sums go by doc_id, smallest first (null before all), and rows of
equal id and sum by their place in the input, so that exactly k rows are kept;
without labels all weights are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import ship, written
from .sample import per_label

BUCKETS = 1 << 16


def features(t: bb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of every pair of adjoining words of a block."""
    w = bb.words(t, bb.ALNUM)
    row = np.repeat(np.arange(len(t)), np.diff(w.offs))
    pair = bb.grams(w.hashes, 2)
    ok = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    both = np.concatenate([w.hashes, pair[ok]]) if len(ok) else w.hashes
    return np.concatenate([row, row[ok]]) if len(ok) else row, (both % np.uint64(BUCKETS)).astype(np.int64)


def model(docs: DataFrame, good: set[int]) -> np.ndarray:
    """Log ratio of target to raw for each bucket, with add-one counts."""
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for t in bb.blocks(batch.column("text")):
                row, bucket = features(t)
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = np.array([i in shared.value for i in ids[t.first : t.first + len(t)]], dtype=bool)
                target += np.bincount(bucket[chosen[row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    sums = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not good:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth(rows: DataFrame, k: int, column: str, most: int = 10_000) -> tuple[object, int]:
    """The k-th smallest value of a column and how many rows of that value it takes; counts ranges until few rows are left."""
    r = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    lo, hi = r["a"], r["b"]
    while lo != hi:
        inside = rows.where((F.col(column) >= F.lit(lo)) & (F.col(column) <= F.lit(hi)))
        if inside.count() <= most:
            values = sorted(r[0] for r in inside.select(column).collect())
            return values[k - 1], k - values.index(values[k - 1])
        at = F.least(F.lit(1023), F.floor((F.col(column) / 1024 - F.lit(lo) / 1024) / F.lit(hi / 1024 - lo / 1024) * 1024).cast("int"))
        for b in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("b").collect():
            if b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            k -= b["n"]
    return lo, k


def resample(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fraction: float = 0.85, most: int = 3000, per_feature: float | None = None, seed: int = 7) -> DataFrame:
    """Per document: features, log weight, Gumbel sum, and whether the draw keeps it."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    good = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y = 1 and doc_id is not null")
    ratio = spark.sparkContext.broadcast(model(docs, {r[0] for r in per_label(good, "y", most).select("doc_id").collect()}))

    def weigh(batches):
        for batch in batches:
            for t in bb.blocks(batch.column("text")):
                row, bucket = features(t)
                n = np.bincount(row, minlength=len(t))
                total = np.bincount(row, weights=ratio.value[bucket], minlength=len(t))
                if per_feature is not None:
                    total = per_feature * total / np.maximum(n, 1)
                yield pa.record_batch([batch.column("doc_id").slice(t.first, len(t)), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "n_features", "log_weight"])

    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    got = docs.mapInArrow(weigh, "doc_id long, n_features long, log_weight double").withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    got = written(got.withColumn("row", F.monotonically_increasing_id()), "weights")
    order = got.select((-F.col("gumbel_key")).alias("x"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "row")
    left = int(got.count() * fraction)
    if not left:
        return got.drop("row").withColumn("kept", F.lit(False))
    bounds = []
    for c in ("x", "id", "row"):
        value, left = kth(order, left, c)
        bounds.append(value)
        order = order.where(F.col(c) == F.lit(value))
    x, i, r = bounds
    mine = -F.col("gumbel_key"), F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("row")
    kept = (mine[0] < x) | ((mine[0] == x) & ((mine[1] < i) | ((mine[1] == i) & (mine[2] <= r))))
    return got.withColumn("kept", kept).drop("row")
