"""Benchmark decontamination by winnowing.

Both sides hash every K consecutive words; in each window of 13 - K + 1 such
hashes the minimum is kept as a fingerprint. A shared run of 13 words holds one
whole window, whose minimum is the same on both sides, so no shared run is
missed. Equal fingerprints are extended word by word to the 13-word windows of
the item that hold them, and each window found is compared byte by byte.
Items of fewer than 13 words are one window; they are looked up by their own length.

The benchmark is a stated query set: it is read in blocks of at most
`block_bytes` of text (the size bound of what is broadcast), and every block
is held against all documents. Documents are only read, never shuffled, with
one block; with more, per-document hit spans of the blocks are merged by row.

Defined results: null, empty or wordless text has no words and is clean; rows
of the benchmark with null id or text, or without words, are ignored; item ids
that repeat count once; repeated document rows give one row each; other columns
of either table are ignored (`documents` may clash in any name but id and text).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import CARRIED, carried, carried_once, input_rows, schema_of, ship

WINDOW = 13
K = 5
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Index:
    """Fingerprints of one block of items; plain arrays, so it can be broadcast."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = bb.Texts(0, *_joined([t for _, t in items]))
        w = bb.words(texts, bb.ALNUM)
        counts = np.diff(w.offs)
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [_WORD.findall(t.encode().lower()) for _, t in items]
        self.hashes = w.hashes
        self.item = np.repeat(np.arange(len(items)), counts)
        self.offs = w.offs
        long_ = counts >= WINDOW
        g = bb.grams(w.hashes, K)
        ok = bb.inside_rows(w.offs, K, len(g))
        values = np.where(ok, g, np.iinfo(np.uint64).max)
        picked = np.flatnonzero(bb.minimizers(values, WINDOW - K + 1) & ok) if len(g) else np.zeros(0, int)
        picked = picked[long_[self.item[picked]]]
        order = np.argsort(g[picked], kind="stable")
        self.at = picked[order]
        self.keys = g[self.at] if len(g) else np.zeros(0, np.uint64)
        self.short = {}
        for n in np.unique(counts[(counts > 0) & ~long_]):
            who = np.flatnonzero(counts == n)
            keys = bb.grams(w.hashes, int(n))[w.offs[who]]
            order = np.argsort(keys, kind="stable")
            self.short[int(n)] = (keys[order], who[order])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offs


def _pairs(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into found, into sorted keys) of equal values."""
    lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    n = hi - lo
    left = np.repeat(np.arange(len(found)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _spans(index: Index, t: bb.Texts, w: bb.Words) -> set[tuple[int, int, int]]:
    """(first word, end word, item) of every item window that occurs, adjoining ones on one diagonal merged."""
    out = set()
    h, n = w.hashes, len(w.hashes)
    doc_of = np.repeat(np.arange(len(t)), np.diff(w.offs))
    g = bb.grams(h, K)
    if len(g) and len(index.keys):
        ok = bb.inside_rows(w.offs, K, len(g))
        picked = np.flatnonzero(bb.minimizers(np.where(ok, g, np.iinfo(np.uint64).max), WINDOW - K + 1) & ok)
        near = np.minimum(np.searchsorted(index.keys, g[picked]), len(index.keys) - 1)
        picked = picked[index.keys[near] == g[picked]]
        for part in np.array_split(picked, len(picked) // 4096 + 1):
            a, b = _pairs(index.keys, g[part])
            p, q = part[a], index.at[b]
            if not len(p):
                continue
            shift = np.arange(-(WINDOW - K), WINDOW)
            pp, qq = p[:, None] + shift, q[:, None] + shift
            inside = (pp >= w.offs[doc_of[p]][:, None]) & (pp < w.offs[doc_of[p] + 1][:, None])
            inside &= (qq >= index.offs[index.item[q]][:, None]) & (qq < index.offs[index.item[q] + 1][:, None])
            same = inside & (h[np.clip(pp, 0, n - 1)] == index.hashes[np.clip(qq, 0, len(index.hashes) - 1)])
            run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            full = run[:, WINDOW:] - run[:, :-WINDOW] == WINDOW
            i, s = np.nonzero(full)
            out.update(zip((p[i] + shift[s]).tolist(), (q[i] + shift[s]).tolist()))
    raw = {}

    def same_words(p: int, n_: int, item: int, at: int) -> bool:
        d = int(doc_of[p])
        if d not in raw:
            raw.clear()
            raw[d] = _WORD.findall(t.row(d).lower())
        p -= int(w.offs[d])
        return raw[d][p : p + n_] == index.words[item][at : at + n_]

    spans = set()
    for p, q in sorted(out):
        item = int(index.item[q])
        if same_words(p, WINDOW, item, q - int(index.offs[item])):
            spans.add((p, p + WINDOW, item))
    for size, (keys, who) in index.short.items():
        g = bb.grams(h, size)
        if not len(g):
            continue
        ok = bb.inside_rows(w.offs, size, len(g))
        near = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        picked = np.flatnonzero(ok & (keys[near] == g))
        a, b = _pairs(keys, g[picked])
        for p, item in zip(picked[a].tolist(), who[b].tolist()):
            if same_words(p, size, item, 0):
                spans.add((p, p + size, item))
    return spans


def _scan(index: Index, t: bb.Texts) -> tuple[np.ndarray, list[list[int]], list[list[tuple[int, int]]]]:
    """Words, item numbers and hit spans (in words of the text) of every row."""
    w = bb.words(t, bb.ALNUM)
    items: list[set] = [set() for _ in range(len(t))]
    spans: list[set] = [set() for _ in range(len(t))]
    for p, e, item in _spans(index, t, w):
        d = int(np.searchsorted(w.offs, p, "right")) - 1
        items[d].add(item)
        spans[d].add((p - int(w.offs[d]), e - int(w.offs[d])))
    return np.diff(w.offs), [sorted(x) for x in items], [_merged(x) for x in spans]


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in ids})).encode()).hexdigest()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Items in blocks of about block_bytes, each collected on its own."""
    b = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["id"], r["text"]) for r in part.distinct().orderBy("id", "text").collect()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, min_share: int = 20, carry: bool = False) -> DataFrame:
    """Per document: words, words hit, items with an occurring window, digest of their ids, verdict.

    contaminated: n_hit > 0 and min_share * n_hit >= n_words.
    carry: the input row comes along as the struct `input_row`."""
    spark = documents.sparkSession
    ship(spark)
    docs = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    columns = documents.columns
    indexes = [spark.sparkContext.broadcast(Index(items)) for items in _blocks(benchmark, item_id, item_text, block_bytes)]

    if len(indexes) == 1:
        shared = indexes[0]

        def whole(batches):
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [input_rows(batch, columns, text) for _ in range(carry)]
                for t in bb.blocks(batch.column("text")):
                    n_words, items, spans = _scan(index, t)
                    hit = np.array([sum(b - a for a, b in s) for s in spans], dtype=np.int64)
                    named = [{int(index.ids[i]) for i in x} for x in items]
                    yield pa.record_batch(
                        [
                            ids.slice(t.first, len(t)),
                            pa.array(n_words.astype(np.int64)),
                            pa.array(hit),
                            pa.array([len(x) for x in named], pa.int64()),
                            pa.array([_digest(x) for x in named]),
                            pa.array((hit > 0) & (min_share * hit >= n_words)),
                            *[x.slice(t.first, len(t)) for x in rows],
                        ],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *[CARRIED] * carry],
                    )

        return documents.select(*docs, *carried_once(documents, text, carry)).mapInArrow(whole, schema_of(documents, SCHEMA, carry))

    docs = documents.select(*docs, *carried(carry)).withColumn("row", F.monotonically_increasing_id())
    parts = []
    for k, shared in enumerate(indexes):

        def partly(batches, shared=shared, k=k):
            index = shared.value
            for batch in batches:
                for t in bb.blocks(batch.column("text")):
                    n_words, items, spans = _scan(index, t)
                    keep = [i for i in range(len(t)) if k == 0 or items[i]]
                    at = pa.array([t.first + i for i in keep], pa.int64())
                    yield pa.record_batch(
                        [
                            batch.column("doc_id").take(at),
                            batch.column("row").take(at),
                            pa.array([int(n_words[i]) for i in keep], pa.int64()),
                            pa.array([[str(int(index.ids[x])) for x in items[i]] for i in keep], pa.list_(pa.string())),
                            pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in keep], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        ],
                        names=["doc_id", "row", "n_words", "items", "spans"],
                    )

        parts.append(docs.select("doc_id", "row", "text").mapInArrow(partly, "doc_id long, row long, n_words long, items array<string>, spans array<struct<a: long, b: long>>"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    covered = F.expr("aggregate(spans, struct(0L as n, 0L as to), (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.to)) as n, greatest(s.to, x.b) as to)).n")
    out = merged.select(*["row"] * carry, "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = out.withColumn("contaminated", F.expr(f"n_hit > 0 and {min_share} * n_hit >= n_words"))
    return out.join(docs.select("row", CARRIED), "row").drop("row") if carry else out
