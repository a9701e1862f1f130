"""Removal of repeated strings by sorted, sampled suffixes.

Units are the bytes of the texts, or their words (hashes of lower-cased words).
A window is `length` units. Its anchor is the place of the smallest hash of the
`gram`-unit strings inside it (leftmost of equals), so equal windows have equal
anchors at equal places; neighbouring windows with one anchor form a run, and
the suffix of a run starts with the gram at its anchor, its leading token.

1. Suffixes are range-partitioned by leading token and then by a 128-bit BLAKE2
   digest of the units that the run's windows cover, with splitters that Spark
   samples; a hot token or cover is split like any other. Buckets are sorted
   and neighbours compared; the outermost rows of each bucket (REACH or fewer on
   a side) are compared across bucket boundaries. Runs whose cover another run
   has repeat in full. A leading token that is unique means that no window of
   its run repeats.
2. Runs that share the leading token with a different cover may repeat in part.
   Their units are sent to one bucket for each token (several, by place of the
   window, if the token has over HOT such runs). There the suffixes from the
   anchor and the reversed prefixes before it are sorted by multikey quicksort,
   and the lengths of common prefixes of neighbours say, for every place of the
   anchor in a window, which windows are equal, unit by unit.

Sorted rows are a few integers, about one for every (length - gram) / 2 units;
texts move once, to where their runs are looked at.

Defined results: null text is empty; texts of fewer units than `length` keep
everything; repeated rows repeat each other in full; matches never cross
documents; an empty table gives no rows; other columns are ignored unless
carried (their names may clash with any of ours). With `across`, a string counts
as repeated only if another row holds it too; the same doc_id twice is two rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import CARRIED, carried, schema_of, ship, spread, written

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64(28)
SEGMENT = 1 << 22
HOT = 1000
MOST_PARTS = 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def rolling(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` units from every place, from prefix sums."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * bb.powers(BASE, len(units)), out=sums[1:])
    return bb.mix((sums[size:] - sums[:n]) * bb.powers(INVERSE, n))


def runs(units: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(row, first window, last window, anchor, leading token) of every run; places count from the row's start."""
    sizes = np.diff(offs)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64)
    g = rolling(units, gram)
    key = (g >> PLACE << PLACE) | np.arange(len(g), dtype=np.uint64)
    anchor = (bb.sliding_min(key, length - gram + 1) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    n = len(anchor)
    first, last = offs[rows], offs[rows + 1] - length
    ok = np.zeros(n + 1, np.int32)
    ok[first] += 1
    np.add.at(ok, last + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    begins = ok.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    begins[first] = True
    a = np.flatnonzero(begins)
    row = rows[np.searchsorted(first, a, "right") - 1]
    b = np.minimum(np.append(a[1:], n) - 1, offs[row + 1] - length)
    base = offs[row]
    return row, a - base, b - base, anchor[a] - base, g[anchor[a]]


def units_of(t: bb.Texts, word: bool) -> tuple[np.ndarray, np.ndarray]:
    if not word:
        return t.data, t.offs
    w = bb.words(t, bb.NON_SPACE)
    return w.hashes, w.offs


def segments(units: np.ndarray, offs: np.ndarray, length: int):
    """(row number of the first, place of the first unit, units, offs): a long row alone, in parts that share no window."""
    if len(offs) > 2 or len(units) <= SEGMENT:
        yield 0, 0, units, offs
        return
    for at in range(0, max(1, len(units) - length + 1), SEGMENT):
        part = units[at : at + SEGMENT + length - 1]
        yield 0, at, part, np.array([0, len(part)])


def digests(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(d1, d2) of the units from each start to each end."""
    raw = memoryview(np.ascontiguousarray(units).view(np.uint8))
    size = units.itemsize
    blake = hashlib.blake2b
    every = b"".join([blake(raw[x:y], digest_size=16).digest() for x, y in zip((starts * size).tolist(), (ends * size).tolist())])
    return np.frombuffer(every, np.int64).reshape(-1, 2)


def _flags(m: np.ndarray, d: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sorted streaks have another of equal token and cover near them, and which one of equal token and other cover."""
    whole, part = np.zeros(len(m), dtype=bool), np.zeros(len(m), dtype=bool)
    for k in range(1, reach + 1):
        token = m[k:] == m[:-k]
        cover = token & (d[k:] == d[:-k]).all(1)
        for mask, out in ((cover, whole), (token & ~cover, part)):
            out[k:] |= mask
            out[:-k] |= mask
    return whole, part


def compare_neighbours(batches, across: bool, reach: int, task: int):
    """Rows (row, a, b, at, m, d1, d2) sorted by (m, d1, d2, row, a): those that repeat in full or may in part,
    and the first and last `reach` streaks, numbered in `edge`. A streak is a row, or with across all rows of one text and cover."""
    held = None
    context = np.zeros((0, 3), np.int64)
    done = 0

    def out(table: pa.Table, last: bool):
        nonlocal held, context, done
        keys = np.stack([table.column(c).to_numpy() for c in ("m", "d1", "d2")], axis=1)
        new = np.ones(len(table), dtype=bool)
        if across:
            row = table.column("row").to_numpy()
            new[1:] = (keys[1:] != keys[:-1]).any(1) | (row[1:] != row[:-1])
        starts = np.flatnonzero(new)
        ready = len(starts) if last else max(0, len(starts) - reach)
        every = np.concatenate([context, keys[starts]])
        whole, part = (x[len(context) : len(context) + ready] for x in _flags(every[:, 0], every[:, 1:], reach))
        nth = np.arange(done, done + ready)
        edge = np.where(nth < reach, nth + 1, 0)
        if last:
            left = ready - np.arange(ready)
            edge = np.where((edge == 0) & (left <= reach), 20 - left, edge)
        end = len(table) if ready == len(starts) else int(starts[ready])
        streak = np.cumsum(new)[:end] - 1
        keep = np.flatnonzero((whole | part | (edge > 0))[streak])
        chosen = streak[keep]
        got = table.take(pa.array(keep))
        for name, values in (("whole", whole), ("part", part), ("edge", edge.astype(np.int32))):
            got = got.append_column(name, pa.array(values[chosen]))
        got = got.append_column("task", pa.array(np.full(len(got), task, np.int32)))
        context = every[: len(context) + ready][-reach:]
        done += ready
        held = table.slice(end)
        return got.to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None and len(held):
            table = pa.concat_tables([held, table]).combine_chunks()
        if len(table):
            yield from out(table, False)
    if held is not None and len(held):
        yield from out(held.combine_chunks(), True)


def across_boundaries(edges: list, reach: int) -> list[tuple[int, int, bool, bool]]:
    """(task, edge, whole, part) of the outermost streaks (task, edge, m, d1, d2) of the buckets, where a neighbour adds something."""
    edges = sorted(edges, key=lambda r: (r[0], r[1]))
    if not edges:
        return []
    keys = np.array([tuple(r[2:5]) for r in edges], dtype=np.int64).reshape(-1, 3)
    whole, part = _flags(keys[:, 0], keys[:, 1:], reach)
    return [(r[0], r[1], bool(w), bool(p)) for r, w, p in zip(edges, whole, part) if w or p]


def multikey_quicksort(tokens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows of tokens (rows, depth) inside each group; groups are numbers that stand together.

    All classes are split at once: by the token of their middle row into less,
    equal and greater; the equal part goes on with the next token."""
    n, depth = tokens.shape
    order = np.arange(n)
    at = np.zeros(n, dtype=np.int64)  # next token of the class at each place
    start = np.zeros(n, dtype=np.int64)  # first place of the class
    if n:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        start = np.repeat(first, np.diff(np.append(first, n)))
    places = np.arange(n)
    while len(places):
        cls = start[places]
        begins = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        sizes = np.diff(np.append(begins, len(places)))
        live = np.repeat((sizes > 1) & (at[places[begins]] < depth), sizes)
        if not live.all():
            places = places[live]
            continue
        token = tokens[order[places], at[places]]
        pivot = np.repeat(token[begins + sizes // 2], sizes)
        side = (token > pivot).astype(np.int8) - (token < pivot) + 1
        cls = np.repeat(np.arange(len(begins)), sizes) * 3 + side
        sort = np.argsort(cls, kind="stable")
        order[places] = order[places][sort]
        cls = cls[sort]
        at[places] += cls % 3 == 1
        new = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        start[places] = np.repeat(places[new], np.diff(np.append(new, len(places))))
    return order


def common(tokens: np.ndarray, group: np.ndarray, units: int) -> np.ndarray:
    """Units that each sorted row shares with the row before it; -1 at the start of a group. A token has `units` of them, first in its high bytes."""
    out = np.full(len(tokens), -1, dtype=np.int64)
    if len(tokens) < 2:
        return out
    differ = tokens[1:] != tokens[:-1]
    some, where = differ.any(1), differ.argmax(1)
    k = np.arange(len(where))
    x = tokens[1:][k, where] ^ tokens[:-1][k, where]
    inside = sum(((x >> np.uint64(64 - 8 * j)) == 0).astype(np.int64) for j in range(1, 8)) if units == 8 else 0
    out[1:] = np.where(group[1:] != group[:-1], -1, np.where(some, where * units + inside, tokens.shape[1] * units))
    return out


def _matrix(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Tokens of the units from `first` on (step 1) or before it, backwards (step -1); 0 after `sizes` of them."""
    k = np.arange(width)
    at = np.clip(first[:, None] + (k if step > 0 else -1 - k), 0, len(data) - 1)
    out = np.where(k < sizes[:, None], data[at], data.dtype.type(0))
    return out if data.itemsize == 8 else out.reshape(len(first), -1, 8).view(">u8")[:, :, 0].astype(np.uint64)


def equal_windows(group, row, a, b, at, data, offs, length: int, gram: int, across: bool):
    """(index, first, end) in units of what the windows of the runs cover that another window of the group equals."""
    n, span = len(group), length - gram + 1
    pad = 1 if data.itemsize == 8 else 8
    round_up = lambda x: -(-x // pad) * pad
    first = offs[:-1] + at - a
    sides = []
    for sizes, width, step in ((b + length - at, round_up(length), 1), (at - a, round_up(max(span - 1, 1)), -1)):
        tokens = _matrix(data, first, sizes, width, step)
        order = multikey_quicksort(tokens, group)
        sides.append((order, common(tokens[order], group, pad)))
    mark = np.zeros((n, span + 2), dtype=np.int8)
    cls = np.zeros((2, n), dtype=np.int64)
    for k in range(span):  # units of the window before its anchor
        i = np.flatnonzero((at - b <= k) & (k <= at - a))
        if len(i) < 2:
            continue
        for c, (order, shared), need in zip(cls, sides, (length - k, k)):
            c[order] = np.cumsum(shared < need)
        key = cls[0, i] * (n + 1) + cls[1, i]
        o = np.lexsort((row[i], key))
        key, who = key[o], row[i][o]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.append(begins[1:], len(key))
        twice = who[begins] != who[ends - 1] if across else ends - begins > 1
        mark[i[o], k + 1] = np.repeat(twice, ends - begins)
    step = np.diff(mark, axis=1)
    i, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    return i, at[i] - high, at[i] - low + length


def match_runs(batches, length: int, gram: int, across: bool, word: bool, limit: int = 1 << 22):
    """(row, a, e) of repeated units, from rows (m, part, row, a, b, at, units) sorted by (m, part)."""

    def out(table: pa.Table):
        m, part, row, a, b, at = (table.column(c).to_numpy() for c in ("m", "part", "row", "a", "b", "at"))
        group = np.cumsum(np.r_[0, (m[1:] != m[:-1]) | (part[1:] != part[:-1])])
        units = table.column("units").combine_chunks()
        units = units.cast(pa.large_binary()) if not isinstance(units, pa.ChunkedArray) else pa.concat_arrays(units.chunks).cast(pa.large_binary())
        offs = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        if word:
            data, offs = np.frombuffer(data.tobytes(), np.uint64), offs // 8
        i, first, end = equal_windows(group, row, *(x.astype(np.int64) for x in (a, b, at)), data, offs, length, gram, across)
        return pa.record_batch([pa.array(row[i]), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names=["row", "a", "e"])

    held, size, most = [], 0, limit
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        m, part = table.column("m").to_numpy(), table.column("part").to_numpy()
        new = np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1
        if len(new):
            yield out(table.slice(0, int(new[-1])))
            table = table.slice(int(new[-1])).combine_chunks()
        held, size = table.to_batches(), table.nbytes
        most = max(limit, 2 * size)
    if held and sum(map(len, held)):
        yield out(pa.Table.from_batches(held).combine_chunks())


def spans(documents: DataFrame, length: int, gram: int, word: bool, across: bool) -> DataFrame:
    """(row, found): the spans to remove, in units, for rows of (row, text, ...) that have any.

    The join takes all of `documents`' columns, so that its exchange of the texts is
    the one that a later join of the same rows uses again."""
    spark = documents.sparkSession
    n = spread(spark)
    reach = 2 if across else 1

    def suffixes(batches):
        for batch in batches:
            rows = batch.column("row")
            for t in bb.blocks(batch.column("text")):
                for _, base, units, offs in segments(*units_of(t, word), length):
                    row, a, b, at, m = runs(units, offs, length, gram)
                    if len(row):
                        d = digests(units, offs[row] + a, offs[row] + b + length)
                        columns = [(x + base).astype(np.int32) for x in (a, b, at)]
                        yield pa.record_batch([rows.take(pa.array(row + t.first)), *map(pa.array, columns), pa.array(m.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["row", "a", "b", "at", "m", "d1", "d2"])

    def neighbours(batches):
        yield from compare_neighbours(batches, across, reach, TaskContext.get().partitionId())
        bb.give_back()

    found = documents.select("row", "text").mapInArrow(suffixes, "row long, a int, b int, at int, m long, d1 long, d2 long")
    found = found.repartitionByRange(n, "m", "d1", "d2", "row").sortWithinPartitions("m", "d1", "d2", "row", "a")
    found = written(found.mapInArrow(neighbours, "row long, a int, b int, at int, m long, d1 long, d2 long, whole boolean, part boolean, edge int, task int"), "runs")
    # at most 2 * reach streaks of each bucket
    more = across_boundaries([tuple(r) for r in found.where("edge > 0").select("task", "edge", "m", "d1", "d2").distinct().collect()], reach)
    if more:
        # from Arrow: a list of rows would go through Python workers of another kind, which stay in every executor
        kinds = [("task", pa.int32()), ("edge", pa.int32()), ("whole_too", pa.bool_()), ("part_too", pa.bool_())]
        patch = spark.createDataFrame(pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds, zip(*more))}))
        found = found.join(F.broadcast(patch), ["task", "edge"], "left").withColumns({c: F.col(c) | F.coalesce(f"{c}_too", F.lit(False)) for c in ("whole", "part")})
    whole = found.where("whole").select("row", "a", (F.col("b") + length).alias("e"))

    span = length - gram + 1
    part = found.where("part").select("row", "a", "b", "at", "m")
    hot = part.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    part = part.join(hot, "m", "left").withColumn("s", F.expr(f"cast(ceil({span} / least({MOST_PARTS}, coalesce(ceil(n / {HOT}), 1))) as int)"))
    part = part.select("row", "a", "b", "at", "m", "s", F.expr("explode(sequence(cast(floor((at - b) / s) as int), cast(floor((at - a) / s) as int)))").alias("part"))
    part = part.select("row", F.expr("struct(cast(greatest(a, at - (part + 1) * s + 1) as int) as a, cast(least(b, at - part * s) as int) as b, at, m, part)").alias("r"))
    part = part.groupBy("row").agg(F.collect_list("r").alias("runs"))

    def cut(batches):
        names = ["row", "a", "b", "at", "m", "part", "units"]
        for batch in batches:
            lists = batch.column("runs")
            for t in bb.blocks(batch.column("text")):
                units, offs = units_of(t, word)
                mine = lists.slice(t.first, len(t))
                values = mine.flatten()
                which = np.repeat(np.arange(len(t)), np.diff(mine.offsets.to_numpy()))
                a, b, at, m, part = (values.field(k).to_numpy() for k in range(5))
                raw = memoryview(np.ascontiguousarray(units).view(np.uint8))
                size = units.itemsize
                lo, hi = (offs[which] + a) * size, (offs[which] + b + length) * size
                for s in range(0, len(a), 4096):
                    e = min(s + 4096, len(a))
                    own = pa.array([bytes(raw[x:y]) for x, y in zip(lo[s:e].tolist(), hi[s:e].tolist())], pa.binary())
                    yield pa.record_batch([batch.column("row").take(pa.array(which[s:e] + t.first)), *(pa.array(x[s:e]) for x in (a, b, at, m, part)), own], names=names)

    def match(batches):
        yield from match_runs(batches, length, gram, across, word)
        bb.give_back()

    sent = documents.join(part, "row").mapInArrow(cut, "row long, a int, b int, at int, m long, part int, units binary")
    partial = sent.repartition(n, "m", "part").sortWithinPartitions("m", "part").mapInArrow(match, "row long, a int, e int")
    return whole.unionByName(partial).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "e"))).alias("found"))


def merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in found:
        if out and r["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["e"])
        else:
            out.append([r["a"], r["e"]])
    return [tuple(x) for x in out]


def byte_spans(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, each up to the word after it."""
    data = np.frombuffer(raw, np.uint8)
    w = bb.words(bb.Texts(0, data, np.array([0, len(data)])), bb.NON_SPACE)
    starts = [*w.starts.tolist(), len(raw)]
    return [(starts[a], starts[e]) for a, e in gone]


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, e in gone:
        parts.append(raw[at:a])
        at = e
    return b"".join([*parts, raw[at:]])


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, gram: int = 256, unit: str = "byte", across: bool = False, stable: bool = False, carry: bool = False) -> DataFrame:
    """Per document: bytes, bytes and spans removed, the digest of the bytes kept, and they as text.

    unit: `byte` or `word`, what `length` and `gram` count. across: only what another row holds too goes.
    `text` drops bytes of characters that a removal has cut, and is null where the input is.
    stable: `documents` is a table that gives the same rows in the same partitions when read
    again; others are written first. carry: the other input columns come along as the struct `input_row`."""
    spark = documents.sparkSession
    ship(spark)
    word = unit == "word"
    if not stable:
        documents = written(documents, "input")
    rest = [c for c in documents.columns if c != text]
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carried(carry, rest)).withColumn("row", F.monotonically_increasing_id())
    found = spans(docs, length, gram, word, across)

    def apply(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for d, t, f in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("found").to_pylist()):
                raw, gone = (t.as_py() or "").encode(), merged(f or [])
                gone = byte_spans(raw, gone) if word and gone else gone
                kept = kept_bytes(raw, gone) if gone else raw
                rows.append((d, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if t.is_valid else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.record_batch([*columns, *[batch.column(CARRIED) for _ in range(carry)]], names=[*names, *[CARRIED] * carry])
            bb.give_back()

    return docs.join(found, "row", "left").mapInArrow(apply, schema_of(documents.select(*rest), SCHEMA, carry))
