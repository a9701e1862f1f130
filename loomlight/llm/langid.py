"""Language identification by prediction by partial matching.

Each language has a context tree over the last `ORDER` bytes (A-Z as a-z). A node
exists for every context that the sample has, and holds symbol counts; a symbol
that a node has not seen costs the node's escape (distinct / (total + distinct),
method C) and goes to the next shorter context, with the symbols already refused
excluded. After training the statistics are frozen, so the exact code length of
every symbol in every node is one table entry, and a text costs one look-up per
byte: the languages' code lengths are added up and the shortest wins. The score
is the winner's posterior probability under equal priors.

Learned from a bounded sample (`most` documents and `most_bytes` bytes for each
language, whole texts); every text is scored whole. Bytes that the sample lacks
are one symbol. The table, which is broadcast, holds at most MODEL_BYTES: beyond
that the rarest contexts are left out, so the tree is shorter there.

Defined results: null text, and text without a letter, is `und` with score 0;
rows of null lang are never learned from; with no labelled rows all is `und`;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import CARRIED, carried_once, input_rows, schema_of, ship, text_id
from .sample import MOST_BYTES, per_label, within_bytes

ORDER = 3
MODEL_BYTES = 96 << 20
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = bb.byte_class([*range(65, 91), *range(97, 123)])


def symbols(texts: list[bytes]) -> np.ndarray:
    """Symbol of each byte: 1.. for those of the texts, 0 for all others."""
    seen = np.zeros(256, dtype=bool)
    for t in texts:
        seen[bb.LOWER[np.frombuffer(t, np.uint8)]] = True
    table = np.zeros(256, dtype=np.int32)
    table[seen] = np.arange(1, seen.sum() + 1)
    return table[bb.LOWER]


def contexts(codes: np.ndarray, starts: np.ndarray, order: int, size: int) -> np.ndarray:
    """The number of each symbol's context, the last symbol in its lowest digit; before a text stands symbol 0."""
    out = np.zeros(len(codes), dtype=np.int32)
    before = codes.astype(np.int32)
    for back in range(1, order + 1):
        before = np.concatenate([before[:1] * 0, before[:-1]])
        before[starts] = 0
        out += before * np.int32(size ** (back - 1))
    return out


def node_of(nodes: list[np.ndarray], size: int) -> np.ndarray:
    """For each context of ORDER symbols its row: that of the longest end of it that is a node."""
    out, base = np.zeros(1, np.int32), 1
    for known in nodes:
        out = np.tile(out, size)
        out[known] = np.arange(base, base + len(known))
        base += len(known)
    return out


def train(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray, list[np.ndarray], np.ndarray]:
    """Languages, symbol of each byte, contexts that are nodes by order, and code lengths (rows * symbols, languages)."""
    langs = sorted({lang for lang, _ in rows})
    table = symbols([t.encode() for _, t in rows])
    size = int(table.max()) + 1
    pairs = []  # per language and order: (context * size + symbol, count)
    for lang in langs:
        texts = [t.encode() for name, t in rows if name == lang]
        codes = table[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        starts = starts[starts < len(codes)]
        pairs.append([np.unique(contexts(codes, starts, o, size).astype(np.int64) * size + codes, return_counts=True) for o in range(ORDER + 1)])
    nodes, left = [], MODEL_BYTES // (4 * size * max(len(langs), 1)) - 1
    for o in range(1, ORDER + 1):
        known, where = np.unique(np.concatenate([p[o][0] // size for p in pairs] or [np.zeros(0, np.int64)]), return_inverse=True)
        often = np.bincount(where, weights=np.concatenate([p[o][1] for p in pairs] or [np.zeros(0)]), minlength=len(known))
        known = np.sort(known[np.argsort(-often, kind="stable")[: max(left, 0)]])
        left -= len(known)
        nodes.append(known)
    bits = np.zeros((1 + sum(map(len, nodes)), size, max(len(langs), 1)), dtype=np.float32)
    for k, own in enumerate(pairs):
        code_lengths(own, nodes, size, bits[:, :, k])
    return langs, table, nodes, bits.reshape(-1, bits.shape[2])


def code_lengths(own: list[tuple[np.ndarray, np.ndarray]], nodes: list[np.ndarray], size: int, out: np.ndarray, step: int = 2048) -> None:
    """Fills out (rows, symbols) with the bits of every symbol in every node of one language."""
    parent, base = np.zeros(1, np.int32), 0
    for o, known in enumerate([np.zeros(1, np.int64), *nodes]):
        pair, n = own[o]
        for s in range(0, len(known), step):
            part = known[s : s + step]
            lo, hi = np.searchsorted(pair, [part[0] * size, (part[-1] + 1) * size])
            at = np.searchsorted(part, pair[lo:hi] // size)
            mine = part[np.minimum(at, len(part) - 1)] == pair[lo:hi] // size
            c = np.zeros((len(part), size))
            c[at[mine], pair[lo:hi][mine] % size] = n[lo:hi][mine]
            p = np.exp2(-out[parent[part % size ** (o - 1)]].astype(np.float64)) if o else np.full((1, size), 1.0 / size)
            out[base + s : base + s + len(part)] = -np.log2(np.maximum(_with_escape(c, p), 1e-30))
        parent = node_of(nodes[:o], size)
        base += len(known)


def _with_escape(c: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances of the symbols of nodes with counts c, given those of the nodes one symbol shorter."""
    seen = c > 0
    total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    left = 1.0 - (shorter * seen).sum(1, keepdims=True)
    escape = np.where(left > 1e-9, kinds / np.maximum(total + kinds, 1), 0.0)
    escape = np.where(total == 0, 1.0, escape)
    scale = np.where(escape > 0, total + kinds, total)
    return np.where(seen, c / np.maximum(scale, 1), escape * shorter / np.maximum(left, 1e-9))


def has_letter(raw: bytes) -> bool:
    if _ASCII_LETTER[np.frombuffer(raw, np.uint8)].any():
        return True
    return bool(_LETTER.search(raw.decode()))


def scores(model, node: np.ndarray, t: bb.Texts) -> tuple[list[str], np.ndarray]:
    """Language and posterior of every row of a block; node is node_of the model's nodes."""
    langs, table, _, bits = model
    size = int(table.max()) + 1
    n = len(t)
    if not langs:
        return [UNKNOWN] * n, np.zeros(n)
    sums = np.zeros((n, len(langs)))
    filled = np.flatnonzero(np.diff(t.offs))
    if len(t.data):
        starts = t.offs[filled]
        codes = table[t.data]
        cost = bits[node[contexts(codes, starts, ORDER, size)] * size + codes]
        sums[filled] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
    best = sums.argmin(1)
    gap = np.minimum((sums - sums.min(1, keepdims=True)) * np.log(2), 700)
    score = 1.0 / np.exp(-gap).sum(1)
    # a text is refused if it holds no letter: one look at all, then at rows without an ASCII one
    ascii_ = np.zeros(n, dtype=bool)
    if len(t.data):
        ascii_[filled] = np.logical_or.reduceat(_ASCII_LETTER[t.data], t.offs[filled])
    names = [langs[b] for b in best]
    for i in np.flatnonzero(~ascii_):
        if not has_letter(t.row(i)):
            names[i], score[i] = UNKNOWN, 0.0
    return names, score


def labelled(documents: DataFrame, most: int, most_bytes: int, doc_id: str, text: str, lang: str, learn) -> list[tuple[str, str]]:
    """(lang, text) of the bounded sample, whole texts."""
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.where(learn).where("lang is not null and text is not null")
    chosen = per_label(d.select("doc_id", "lang"), "lang", most).select("doc_id").distinct()
    ids = [r[0] for r in chosen.collect()]
    chosen = within_bytes(d.where(F.col("doc_id").isin(ids)).select("lang", "text"), "lang", "text", most_bytes)
    return sorted((r["lang"], r["text"]) for r in chosen.collect()) if ids else []


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 150, most_bytes: int = MOST_BYTES, fold: int = 5, carry: bool = False) -> DataFrame:
    """Predicted language of every document; documents of fold 0 by crc32 of the id are never learned from.

    carry: the input row comes along as the struct `input_row`."""
    spark = documents.sparkSession
    ship(spark)
    held_out = F.pmod(text_id(doc_id), F.lit(fold)) == 0
    model = spark.sparkContext.broadcast(train(labelled(documents, most, most_bytes, doc_id, text, lang, ~held_out)))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"), *carried_once(documents, text, carry))
    columns = documents.columns

    def run(batches):
        node = node_of(model.value[2], int(model.value[1].max()) + 1)
        for batch in batches:
            every = [batch.column("doc_id"), batch.column("held_out"), *[input_rows(batch, columns, text) for _ in range(carry)]]
            for t in bb.blocks(batch.column("text")):
                names, score = scores(model.value, node, t)
                own = [x.slice(t.first, len(t)) for x in every]
                yield pa.record_batch([*own[:2], pa.array(names, pa.string()), pa.array(score), *own[2:]], names=["doc_id", "held_out", "lang_pred", "score", *[CARRIED] * carry])

    return docs.mapInArrow(run, schema_of(documents, SCHEMA, carry))
