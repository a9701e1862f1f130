"""Operators whose state runs through a document's rows: grouped Python kernels.

Each group is one document; the kernels keep the clusters or the open chunk only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..plans.shipping import ship
from . import logs, recap

# Scan of candidates, and thresholds of the hierarchical levels.
NEWEST, CHECKS = 500, 100
LEVELS = (0.15, 0.25, 0.4)


def levenshtein(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 once it can't be less."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def weighted_overlap(a: dict, b: dict) -> float:
    keys = set(a) | set(b)
    top = sum(max(a.get(k, 0.0), b.get(k, 0.0)) for k in keys)
    return sum(min(a.get(k, 0.0), b.get(k, 0.0)) for k in keys) / top if top else 0.0


def token_weights(signature: str) -> dict:
    """Weights of the words of a signature: every word is the same letter, so words, pairs and triples by place."""
    words = [w for w in signature.lower().split() if len(w) > 1]
    tokens = words + [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    out: dict = {}
    for i, t in enumerate(tokens):
        out[t] = out.get(t, 0.0) + (1.5 if " " in t else 1.0) * max(0.5, 1 - i / len(tokens) * 0.5)
    return out


def greedy(rows: list[tuple], max_ratio: float, min_overlap: float) -> list[int]:
    """Cluster number of every (signature, category) in order; equal signatures first, then the nearest leader."""
    leaders: list[list] = []  # signature, weights, category counts, leading category
    by_signature: dict[str, int] = {}
    out = []
    for signature, category in rows:
        at = by_signature.get(signature)
        if at is None:
            best, mine = None, None
            for k in range(max(0, len(leaders) - NEWEST), min(len(leaders), max(0, len(leaders) - NEWEST) + CHECKS)):
                other, weights, _, lead = leaders[k]
                longest = max(len(signature), len(other))
                if lead != category or not longest:
                    continue
                ratio = levenshtein(signature, other, int(max_ratio * longest)) / longest
                if ratio > max_ratio:
                    continue
                mine = mine if mine is not None else token_weights(signature)
                overlap = weighted_overlap(mine, weights)
                if (ratio <= max_ratio / 10 or overlap >= min_overlap) and (best is None or (ratio, -overlap) < best[:2]):
                    best = (ratio, -overlap, k)
            if best:
                at = best[2]
            else:
                at = by_signature[signature] = len(leaders)
                leaders.append([signature, token_weights(signature), {}, category])
        counts = leaders[at][2]
        counts[category] = counts.get(category, 0) + 1
        if counts[category] > counts.get(leaders[at][3], 0):
            leaders[at][3] = category
        out.append(at)
    return out


def clusters_greedy(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(doc_id, cluster, n_events, first_ord, category) by order-dependent leader clustering.

    events: doc_id, ord, signature, category; thresholds: doc_id, max_ratio, min_jaccard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        pdf["cluster"] = greedy(list(zip(pdf["signature"], pdf["category"])), float(pdf["max_ratio"].iloc[0]), float(pdf["min_jaccard"].iloc[0]))
        out = pdf.groupby("cluster", as_index=False).agg(n_events=("ord", "size"), first_ord=("ord", "min"), category=("category", "first"))
        out["doc_id"] = pdf["doc_id"].iloc[0]
        return out[["doc_id", "cluster", "n_events", "first_ord", "category"]]

    return events.join(thresholds, "doc_id").groupBy("doc_id").applyInPandas(run, "doc_id long, cluster long, n_events long, first_ord long, category string")


def clusters_hierarchical(events: DataFrame, level: int = 0) -> DataFrame:
    """Leaders by word overlap or edit ratio under the level's distance (0, 1 or 2); every seed is a cluster."""
    most = LEVELS[level]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders, rows = [], []
        for d, o, s, c in pdf.sort_values("ord")[["doc_id", "ord", "signature", "category"]].itertuples(index=False):
            words = set(s.lower().split())
            for k, (other, theirs, cat) in enumerate(leaders):
                longest = max(len(s), len(other), 1)
                overlap = len(words & theirs) / max(1, len(words | theirs))
                if cat == c and min(1 - overlap, levenshtein(s, other, int(most * longest)) / longest) <= most:
                    break
            else:
                k = len(leaders)
                leaders.append((s, words, c))
            rows.append((d, o, k))
        return pd.DataFrame(rows, columns=["doc_id", "ord", "cluster"])

    return events.groupBy("doc_id").applyInPandas(run, "doc_id long, ord long, cluster long")


def chunks_by_chars(events: DataFrame, most_events: int = 80, most_chars: int = 18_000) -> DataFrame:
    """(doc_id, place, chunk): next-fit by events and characters. events: doc_id, place, kind, summary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        out, chunk, n, chars = [], 0, 0, 0
        for kind, summary in zip(pdf["kind"], pdf["summary"]):
            size = len(f"[{kind}] {summary}")
            if n >= most_events or (n and chars + size > most_chars):
                chunk, n, chars = chunk + 1, 0, 0
            n, chars = n + 1, chars + size
            out.append(chunk)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "place": pdf["place"], "chunk": out})

    return events.select("doc_id", "place", "kind", "summary").groupBy("doc_id").applyInPandas(run, "doc_id long, place long, chunk long")


def _sql(spark, sf_dir, steps) -> DataFrame:
    ship(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(steps)


def _events(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, logs.query(*logs.upto_clusters(SPARK), ("", "select doc_id, ord, signature, category from s1 where not used")))


def _greedy(spark, sf_dir):
    return clusters_greedy(_events(spark, sf_dir), _sql(spark, sf_dir, logs.QUERIES["cluster_thresholds"](SPARK)).select("doc_id", F.col("max_ratio").cast("double"), F.col("min_jaccard").cast("double")))


QUERIES = {
    "clusters_greedy": _greedy,
    "clusters_hierarchical": lambda spark, sf_dir: clusters_hierarchical(_events(spark, sf_dir)),
    "recap_chunks_by_chars": lambda spark, sf_dir: chunks_by_chars(_sql(spark, sf_dir, recap.WHOLE["recap_timeline_whole"](SPARK)), recap.MOST_EVENTS, recap.MOST_CHARS),
}
