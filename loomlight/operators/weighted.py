"""Token weights by document: the lists of `enhanced` and the sums of `weights` (text.py) without a row for each token.

Rows are dealt by doc_id, so the tokens of a document meet in the task that cuts
its text: texts are shuffled once, tokens never. Distinct words of a block of
documents get numbers, a gram is numbered by its first words' number and its last
word, and equal numbers are equal tokens: nothing is hashed away.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .text import STOP_WORDS, TECHNICAL

# Bytes of text handled at once (or one document), rows given out at once.
BLOCK, ROWS = 1 << 20, 1 << 16
STOP = frozenset(w.encode() for w in STOP_WORDS)
NUMBER = re.compile(rb"^\d{3}$")


def _either(patterns) -> re.Pattern:
    """One pattern for several; each keeps its own (?i)."""
    return re.compile("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns).encode())


#: The technical patterns of whole tokens, and those of the end of a token: an extension after its point.
WHOLE = _either(p for p in TECHNICAL if p.removeprefix("(?i)").startswith("^"))
END = _either(p for p in TECHNICAL if p.removeprefix("(?i)").startswith(r"\."))


def _bytes(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_SMALL = b"abcdefghijklmnopqrstuvwxyz0123456789._/-"
#: Bytes of the words of the text and of the lower-cased text.
RAW, LOWER = _bytes(_SMALL + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ()"), _bytes(_SMALL)


def technical(token: bytes) -> bool:
    return WHOLE.match(token) is not None or b"." in token and END.search(token) is not None


@lru_cache(1 << 16)
def factors(token: bytes) -> tuple[float, float]:
    """Of the token itself, and of the grams that end with it: a pattern of whole tokens fails at a gram's space."""
    end = b"." in token and END.search(token) is not None
    return (3.0 if end or WHOLE.match(token) else 1.0) * (2.0 if NUMBER.match(token) else 1.0), (3.0 if end else 1.0) * 1.5


def words(texts: pa.Array, kind: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes of `kind` of every text (large binary), and their rows."""
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    mask = kind[data]
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    stops[:-1] &= ~mask[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    begins[edge], stops[edge - 1] = mask[edge], mask[edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.r_[0, np.cumsum(np.flatnonzero(stops) + 1 - starts)].astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[mask])])
    return found, np.searchsorted(offs, starts, "right") - 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every key, from 0 in order of appearance, and the key of every number."""
    got = pa.array(keys).dictionary_encode()
    return got.indices.to_numpy(), got.dictionary.to_numpy()


def _nth(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place inside its row of every item of sorted `rows`."""
    return np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]


class Block:
    """Tokens of some whole documents. `doc` gives each row's document, from 0.

    `levels` holds, for words, 2-grams and 3-grams, the keys of the distinct tokens of the documents
    and the sums of their weights. A key is the document or the number of the gram before, times the number of words, plus the last word."""

    def __init__(self, texts: pa.Array, lowered: pa.Array, doc: np.ndarray):
        number: dict[bytes, int] = {}
        raw, tech_row = words(texts, RAW)
        plain, reg_row = words(lowered, LOWER)
        raw, plain = raw.dictionary_encode(), plain.dictionary_encode()
        of = np.array([number.setdefault(x.lower(), len(number)) if technical(x) else -1 for x in raw.dictionary.to_pylist()], np.int64)
        tech = of[raw.indices.to_numpy()]
        tech, tech_row = tech[tech >= 0], tech_row[tech >= 0]
        of = np.array([number.setdefault(x, len(number)) if len(x) > 1 and x not in STOP else -1 for x in plain.dictionary.to_pylist()], np.int64)
        reg = of[plain.indices.to_numpy()]
        size = self.size = max(1, len(number))
        regular = (reg >= 0) & ~np.isin(reg_row * size + reg, tech_row * size + tech)
        reg, reg_row = reg[regular], reg_row[regular]

        self.words, self.docs, self.doc = pa.array(list(number), pa.binary()), int(doc[-1]) + 1 if len(doc) else 0, doc
        self.n_technical = t = np.bincount(tech_row, minlength=len(doc))
        r = np.bincount(reg_row, minlength=len(doc))
        n_tokens = np.bincount(doc, 2 * t + r + np.maximum(r - 1, 0) + np.maximum(r - 2, 0), self.docs)
        factor = np.array([factors(x) for x in number]).reshape(-1, 2)

        def level(keys, last, row, place, factor):
            numbers, keys = _distinct(keys)
            weight = factor[last] * np.maximum(0.5, 1.0 - (place / n_tokens[doc[row]]) * 0.5)
            return numbers, keys, np.bincount(numbers, weight, len(keys))

        self.levels = []
        nth_tech, nth = _nth(tech_row, t), _nth(reg_row, r)
        last, row = np.concatenate([tech, tech, reg]), np.concatenate([tech_row, tech_row, reg_row])
        place = np.concatenate([nth_tech, t[tech_row] + nth_tech, 2 * t[reg_row] + nth])
        numbers, *found = level(doc[row] * size + last, last, row, place, factor[:, 0])
        self.levels.append(found)
        before = numbers[2 * len(tech) :].astype(np.int64)
        start = 2 * t + r
        for k in (1, 2):  # words after the first of a gram
            inside = np.flatnonzero(nth[: len(reg) - k] + k < r[reg_row[: len(reg) - k]])
            last, row = reg[inside + k], reg_row[inside]
            numbers, *found = level(before[inside] * size + last, last, row, start[row] + nth[inside], factor[:, 1])
            self.levels.append(found)
            before = np.zeros(len(reg), np.int64)
            before[inside] = numbers
            start = start + np.maximum(r - k, 0)

    def tokens(self, k: int, at: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """Documents and words of the distinct tokens `at` of a level."""
        before, last = np.divmod(self.levels[k][0][at], self.size)
        doc, first = self.tokens(k - 1, before) if k else (before, [])
        return doc, [*first, self.words.take(pa.array(last))]

    def weights(self):
        """(document, token, weight) of the distinct tokens, some rows at a time."""
        for k, (keys, sums) in enumerate(self.levels):
            for i in range(0, len(keys), ROWS):
                at = np.arange(i, min(i + ROWS, len(keys)))
                doc, parts = self.tokens(k, at)
                yield doc, (pc.binary_join_element_wise(*parts, b" ") if k else parts[0]).cast(pa.string()), sums[at]

    def stats(self):
        """Of the documents with tokens: document, distinct tokens, distinct grams, sum of weights, technical tokens of a row at most.

        The SQL joins tokens and rows by doc_id, so counts and sums of a repeated doc_id are taken once for each of its rows."""
        n, total = np.zeros((3, self.docs), np.int64), np.zeros(self.docs)
        doc = None
        for k, (keys, sums) in enumerate(self.levels):
            before = keys // self.size
            doc = doc[before] if k else before
            n[k] = np.bincount(doc, minlength=self.docs)
            total += np.bincount(doc, sums, self.docs)
        rows = np.bincount(self.doc, minlength=self.docs)
        most = np.zeros(self.docs, np.int64)
        np.maximum.at(most, self.doc, self.n_technical)
        some = np.flatnonzero(n[0])
        return (some, *((x * rows)[some] for x in (n.sum(0), n[1] + n[2], total)), most[some])


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, for what is not negative."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def whole(batches):
    """(id of every document, Block) from rows (doc_id, text, lowered) sorted by doc_id."""

    def blocks(held):
        table = pa.Table.from_batches(held)
        if not len(table):
            return
        ids = table.column(0).combine_chunks()
        texts, lowered = (table.column(c).cast(pa.large_binary()).combine_chunks() for c in (1, 2))
        firsts = np.r_[0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1, len(table)]
        sizes = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())][firsts]
        i = 0
        while i < len(firsts) - 1:
            j = max(int(np.searchsorted(sizes, sizes[i] + BLOCK, "right")) - 1, i + 1)
            a, e = int(firsts[i]), int(firsts[j])
            doc = np.repeat(np.arange(j - i), np.diff(firsts[i : j + 1]))
            yield ids.take(pa.array(firsts[i:j])), Block(texts.slice(a, e - a), lowered.slice(a, e - a), doc)
            i = j

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        new = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1
        cut = int(new[-1]) if len(new) else 0
        if held and not cut and held[-1].column(0)[-1] == ids[0]:
            held.append(batch)
            continue
        yield from blocks([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield from blocks(held)


def _by_document(documents: DataFrame) -> DataFrame:
    """Rows of one doc_id together; those without one meet no document."""
    ship(documents.sparkSession)
    rows = documents.where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text")
    # the SQL's lower() makes one letter of İ, Java's an i and a mark
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", "text", F.expr("lower(replace(text, 'İ', 'i'))").alias("lowered"))


def _id(documents: DataFrame) -> str:
    return f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, "


def token_weights(documents: DataFrame) -> DataFrame:
    """(doc_id, token, weight): every distinct token of every document."""

    def weigh(batches):
        for ids, block in whole(batches):
            for doc, token, weight in block.weights():
                yield pa.record_batch([ids.take(pa.array(doc)), token, pa.array(rounded(weight, 6))], names=["doc_id", "token", "weight"])

    return _by_document(documents).mapInArrow(weigh, _id(documents) + "token string, weight double")


def token_stats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_unique, n_grams, total_weight, n_technical) of every document that has a token."""

    def count(batches):
        for ids, block in whole(batches):
            doc, n_unique, n_grams, total, n_technical = block.stats()
            columns = [ids.take(pa.array(doc)), *map(pa.array, (n_unique, n_grams, rounded(total, 5), n_technical))]
            yield pa.record_batch(columns, names=["doc_id", "n_unique", "n_grams", "total_weight", "n_technical"])

    return _by_document(documents).mapInArrow(count, _id(documents) + "n_unique long, n_grams long, total_weight double, n_technical long")


QUERIES = {
    "token_weights": lambda spark, sf_dir: token_weights(spark.read.parquet(f"{sf_dir}/documents.parquet")),
    "token_stats": lambda spark, sf_dir: token_stats(spark.read.parquet(f"{sf_dir}/documents.parquet")),
}
