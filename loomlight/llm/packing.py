"""Best-fit packing of token pieces by a linear grouping scheme.

Only the histogram of piece lengths (at most `capacity` counts) meets on the
driver. There, large lengths are cut into groups of equal cardinality and
rounded up to the largest of their group; configurations of the sizes left (64
groups, or a finer grouping where that takes fewer sequences) are chosen by the
fullest sum; actual lengths replace the rounded ones, run by
run; small lengths then go best-fit into what is free. The plan is a bounded
list of runs of equal sequences. A piece finds its place from its length and
its rank among the pieces of that length, which comes from a rank inside its
own task plus the counts of the tasks before it, so no length meets in one task.

Defined results: a null text is empty and packs the end id alone; empty tables
give no rows; repeated rows are packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .cluster import ship, written

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter if there are several."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, doc_id: str, text: str, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece, with its task and its rank among the task's pieces of that length."""
    spark = documents.sparkSession
    raw = spark.sparkContext.broadcast(bpe.read(tokenizer))

    def encode(batches):
        encode_one = bpe.encoder(raw.value)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
        for batch in batches:
            rows = [[] for _ in names]
            for d, t in zip(batch.column("doc_id"), batch.column("text")):
                d, ids = d.as_py(), encode_one(t.as_py() or "")
                ids.append(end_id)
                data = np.array(ids, dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(data[start : start + length].tobytes())
                    for c, v in zip(rows, (d, k, start, length, crc, task, int(seen[length]))):
                        c.append(v)
                    seen[length] += 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


class Runs:
    """Runs of sequences with equal contents; free space by size."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.keys = capacity, {}, []

    def put(self, n: int, inside: tuple[int, ...]) -> None:
        if n:
            left = self.capacity - sum(inside)
            if left not in self.free:
                self.free[left] = {}
                insort(self.keys, left)
            self.free[left][inside] = self.free[left].get(inside, 0) + n

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of one length, each into the fullest sequence that takes it."""
        while n:
            i = bisect_left(self.keys, length)
            if i == len(self.keys):
                # new sequences: as many of this length as fit, so that runs stay few
                each = min(self.capacity // length, n)
                self.put(n // each, (length,) * each)
                n %= each
                continue
            left = self.keys[i]
            inside, have = self.free[left].popitem()
            if not self.free[left]:
                del self.free[left]
                self.keys.pop(i)
            took = min(have, n)
            self.put(have - took, inside)
            self.put(took, (*inside, length))
            n -= took

    def all(self) -> list[tuple[int, tuple[int, ...]]]:
        return [(n, inside) for left in self.keys for inside, n in self.free[left].items()]


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs, largest first, in groups of equal cardinality; those rounded up to the same length are one."""
    total = sum(n for _, n in lengths)
    size, out, room = -(-total // groups), [], 0
    for length, n in lengths:
        while n:
            if not room:
                out.append([])
                room = size
            took = min(n, room)
            out[-1].append((length, took))
            n, room = n - took, room - took
    merged = []
    for g in out:
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, group numbers) so that all demand is met: for the largest size left the fullest sum."""
    demand, out = list(demand), []
    for g, size in enumerate(sizes):
        while demand[g]:
            best = {0: ()}
            for h in range(g, len(sizes)):
                for _ in range(min(demand[h] - (h == g), (capacity - size) // sizes[h])):
                    added = {s + sizes[h]: (*c, h) for s, c in best.items() if s + sizes[h] <= capacity - size and s + sizes[h] not in best}
                    if not added:
                        break
                    best |= added
            config = (g, *best[max(best)])
            times = min(demand[h] // config.count(h) for h in set(config))
            for h in config:
                demand[h] -= times
            out.append((times, config))
    return out


def _substitute(configs, groups) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of actual lengths: each group's lengths fill its places in order."""
    left = [[list(r) for r in reversed(g)] for g in groups]
    out = []
    for times, config in configs:
        while times:
            need = {h: config.count(h) for h in config}
            # whole steps that every group's first run can serve alike; else one sequence across runs
            step = min(times, *(left[h][-1][1] // c for h, c in need.items()))
            n, inside = max(step, 1), []
            for h in config:
                inside.append(left[h][-1][0])
                left[h][-1][1] -= n
                if not left[h][-1][1]:
                    left[h].pop()
            out.append((n, tuple(inside)))
            times -= n
    return out


def _grouped(every: list[tuple[int, int]], capacity: int, groups: int, small: int) -> list[tuple[int, tuple[int, ...]]]:
    """The runs for one number of groups."""
    out = Runs(capacity)
    large = _groups([r for r in every if r[0] > small], groups)
    sizes, demand = [g[0][0] for g in large], [sum(n for _, n in g) for g in large]
    for n, inside in _substitute(_configurations(sizes, demand, capacity), large):
        out.put(n, inside)
    for x, n in every:
        if x <= small:
            out.best_fit(x, n)
    return out.all()


def plan(histogram: dict[int, int], capacity: int, groups: int = 64, small: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (how many sequences, their lengths) that hold every piece of the histogram.

    The groups are doubled, which rounds less, until there is one for each large piece; the number with the fewest
    sequences is taken. At most `capacity` lengths are left of them, so each doubling costs the same."""
    small = small or capacity // 4
    every = sorted(((x, n) for x, n in histogram.items() if n and x < capacity), reverse=True)
    full = [(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    counts = [groups]
    while counts[-1] < sum(n for x, n in every if x > small):
        counts.append(2 * counts[-1])
    return full + min((_grouped(every, capacity, g, small) for g in counts), key=lambda runs: sum(n for n, _ in runs))


def places(runs) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of its places."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for n, inside in runs:
        at = 0
        for x in inside:
            rows.setdefault(x, []).append((used.get(x, 0), base, at))
            used[x] = used.get(x, 0) + n
            at += x
        base += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in rows.items()}


def pack(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, groups: int = 64) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = documents.sparkSession
    ship(spark)
    made = written(pieces(documents, doc_id, text, tokenizer, capacity, end_id), "pieces")
    counts = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = spark.sparkContext.broadcast(places(plan(histogram, capacity, groups)))
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                first, base, at = found.value[int(x)]
                k = np.searchsorted(first, rank[i], "right") - 1
                seq[i], off[i] = base[k] + rank[i] - first[k], at[k]
            yield pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, SCHEMA)
