"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings of 4 to
6 bytes) whose presence goes with the toxic label beyond chance in a bounded
labelled sample, two patterns over them (several entries; none at all), and the
label itself, which may be wrong like any voter. A generative model - a latent
class, and per voter the chance to fire under each - is fitted by
expectation-maximisation; what voters have in common beyond the class is estimated
as the correlation of their residuals, and a voter counts as one over the sum of
its correlations. The posteriors are the soft labels on which a linear
classifier over all entries is trained. Every text is scored whole.

Learned from at most `most` rows and `most_bytes` of text for each label, never
from rows of the held-out fold; the classifier has at most MOST_FEATURES weights,
which bounds what is broadcast, and the label model at most MOST_VOTERS voters.

Defined results: null and empty texts get the score of a text without any
entry; rows of labels with null label or id are ignored, a document with
conflicting labels counts once for each; without labels of both kinds every
score is 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import ship, text_id
from .sample import MOST_BYTES, per_label, within_bytes

PREFIXES = (4, 5, 6)
MOST_FEATURES = 4000
MOST_VOTERS = 500
EVIDENCE = 14.0  # log-likelihood ratio that an entry needs
LIFT = 6.0  # times that it must be more frequent in toxic documents
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def entries(t: bb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry hash) of every word and word beginning of a block."""
    w = bb.words(t, bb.ALNUM)
    row = np.repeat(np.arange(len(t)), np.diff(w.offs))
    rows, found = [row], [w.hashes]
    size = w.ends - w.starts
    low = bb.LOWER[t.data].astype(np.uint64)
    for n in PREFIXES:
        i = np.flatnonzero(size >= n)
        h = np.zeros(len(i), np.uint64)
        for j, p in enumerate(bb.powers(bb.MULT, n)):
            h += (low[w.starts[i] + j] + np.uint64(1)) * p
        rows.append(row[i])
        found.append(bb.mix(h ^ (bb.powers(bb.GRAM, n + 1)[n])))
    return np.concatenate(rows), np.concatenate(found)


def presence(rows: np.ndarray, found: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into sorted keys)."""
    if not len(keys) or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == found)
    pair = np.unique(rows[hit].astype(np.int64) * len(keys) + at[hit])
    return pair // len(keys), pair % len(keys)


def one_of_each(rows: list[tuple[int, str]], bands: int = 8, size: int = 3) -> list[tuple[int, str]]:
    """The sample without copies: of rows whose word pairs agree in a band of minima, the first.

    Else every word of a text that was copied often would look like evidence."""
    mults = bb.mix(np.arange(1, bands * size + 1, dtype=np.uint64)) | np.uint64(1)
    seen, out = set(), []
    for t in bb.blocks(pa.array([x for _, x in rows], pa.string())):
        w = bb.words(t, bb.ALNUM)
        for i in range(len(t)):
            h = w.hashes[w.offs[i] : w.offs[i + 1]]
            h = bb.grams(h, min(2, len(h))) if len(h) else h
            low = np.concatenate([(h[k : k + 4096, None] * mults).min(0, keepdims=True) for k in range(0, len(h), 4096)]).min(0) if len(h) else mults
            keys = {(b, low[b * size : (b + 1) * size].tobytes()) for b in range(bands)}
            if not keys & seen:
                out.append(rows[t.first + i])
            seen |= keys
    return out


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def select(df_pos: np.ndarray, df_neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Signed log-likelihood ratio of presence against the label; positive goes with toxic."""
    k = np.array([df_pos, n_pos - df_pos, df_neg, n_neg - df_neg], dtype=np.float64)
    n = n_pos + n_neg
    g = 2 * (_xlogx(k).sum(0) - _xlogx(k[0] + k[1]) - _xlogx(k[2] + k[3]) - _xlogx(k[0] + k[2]) - _xlogx(k[1] + k[3]) + _xlogx(float(n)))
    return np.where(df_pos / n_pos > LIFT * (df_neg + 0.5) / n_neg, g, -g)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 20, related: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, each voter's chance to fire in that class and in the other, and
    its weight. The label is the last voter; it starts the estimate and has no other part in it."""
    v = np.column_stack([votes, gold]).astype(np.float64)
    q = 0.02 + 0.96 * gold
    weight = np.ones(v.shape[1])
    share = q.mean()
    for _ in range(rounds):
        a = (v.T @ q + 0.1) / (q.sum() + 1.0)
        b = (v.T @ (1 - q) + 0.05) / ((1 - q).sum() + 1.0)
        r = v - (q[:, None] * a + (1 - q)[:, None] * b)
        both = r.T @ r
        size = np.sqrt(np.maximum(np.diag(both), 1e-9))
        common = both / size / size[:, None]
        weight = 1 / np.maximum(np.where(common > related, common, 0).sum(0), 1.0)
        logit = np.log(share / (1 - share)) + v @ (weight * (np.log(a) - np.log(b))) + (1 - v) @ (weight * (np.log1p(-a) - np.log1p(-b)))
        q = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        share = min(max(q.mean(), 0.01), 0.99)
    return q, a, b, weight


def fit_linear(row: np.ndarray, entry: np.ndarray, size: int, target: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; (row, entry) are the places of ones."""
    w, b = np.zeros(size), 0.0
    v, c = w.copy(), b
    total, n = weight.sum(), len(target)
    step = 4.0 / (max(1.0, len(row) / n) + 1.0)
    for k in range(rounds):
        g = weight * (1 / (1 + np.exp(-np.clip(np.bincount(row, weights=v[entry], minlength=n) + c, -50, 50))) - target) / total
        nw, nb = v - step * (np.bincount(entry, weights=g[row], minlength=size) + ridge * v), c - step * g.sum()
        m = k / (k + 3)
        v, c = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def train(rows: list[tuple[int, str]], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted entry hashes, their weights, and the bias."""
    rows = one_of_each(rows)
    gold = np.array([y for y, _ in rows], dtype=np.int64)
    n_pos, n_neg = int(gold.sum()), int(len(gold) - gold.sum())
    none = np.zeros(0, np.uint64), np.zeros(0), -50.0
    if not n_pos or not n_neg:
        return none
    at, seen = [], []
    for t in bb.blocks(pa.array([x for _, x in rows], pa.string())):
        r, f = entries(t)
        order = np.lexsort((f, r))
        r, f = r[order], f[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
        at.append(r[new] + t.first)
        seen.append(f[new])
    at, seen = np.concatenate(at), np.concatenate(seen)
    keys, which = np.unique(seen, return_inverse=True)
    pos = np.bincount(which, weights=gold[at], minlength=len(keys))
    score = select(pos, np.bincount(which, minlength=len(keys)) - pos, n_pos, n_neg)
    lead = np.argsort(-score, kind="stable")[:MOST_FEATURES]
    lead = np.sort(lead[score[lead] >= EVIDENCE])
    if not len(lead):
        return none
    index = np.full(len(keys), -1)
    index[lead] = np.arange(len(lead))
    keep = index[which] >= 0
    row, entry = at[keep], index[which[keep]]
    voters = np.argsort(-score[lead], kind="stable")[:MOST_VOTERS]
    place = np.full(len(lead), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters) + 2), dtype=np.float32)
    named = place[entry] >= 0
    votes[row[named], place[entry[named]]] = 1
    fired = np.bincount(row, minlength=len(rows))
    votes[:, -2], votes[:, -1] = fired >= 2, fired == 0
    weight = np.where(gold == 1, prior / n_pos, (1 - prior) / n_neg) * len(rows)
    w, b = fit_linear(row, entry, len(lead), label_model(votes, gold)[0], weight)
    return keys[lead], w, b


def score_block(model, t: bb.Texts) -> np.ndarray:
    keys, weights, bias = model
    row, at = presence(*entries(t), keys)
    logit = np.bincount(row, weights=weights[at], minlength=len(t)) + bias if len(row) else np.full(len(t), bias)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def score(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 2500, most_bytes: int = MOST_BYTES, fold: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every document, 0 to 1."""
    spark = documents.sparkSession
    ship(spark)
    held_out = F.pmod(text_id(doc_id), F.lit(fold)) == held
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~(F.pmod(text_id("doc_id"), F.lit(fold)) == held))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = F.broadcast(per_label(known, "y", most).distinct())  # 2 * most rows
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sampled = docs.join(chosen, "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted((r["y"], r["text"]) for r in within_bytes(sampled, "y", "text", most_bytes).collect())
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = spark.sparkContext.broadcast(train(rows, prior))
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(text_id("doc_id"), F.lit(fold)) == held, F.lit(False)))

    def run(batches):
        for batch in batches:
            for t in bb.blocks(batch.column("text")):
                p = score_block(model.value, t)
                yield pa.record_batch([batch.column("doc_id").slice(t.first, len(t)), batch.column("held_out").slice(t.first, len(t)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, SCHEMA)
