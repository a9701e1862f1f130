"""Near-duplicate groups by b-bit MinHash.

A document's set holds the hashes of its distinct 5-word shingles. Documents
with equal sets form a class that is handled as one. A class's signature keeps
the low bits of ROWS * BANDS minima, packed; each band of full minima is a
bucket key. Every class is paired with the smallest id of each of its buckets;
pairs whose collision-corrected similarity, by bit counts over the packed
signatures, is far too low (over MARGIN standard errors) are left out, the others
are confirmed on the full sets, and confirmed links are closed to components.
Where buckets still hold many pairs of several components, up to STARS more such
rounds follow, each around another class of the bucket's largest component. Then
all classes that share a bucket but not a component are paired as well, so no
pair of a bucket goes unlooked at. A class carries its buckets, BANDS at most, as one
array, so joins by class see one row of each. In crowded buckets the pairs come from
exact prefix filtering of the full sets, rarest shingle first: two sets that are similar
enough share one of their first few, which a passage that many texts hold never is
unless it makes up most of the text. A link of similarity 0.75 misses every band
with a chance of 3e-7.

Nothing but counts, one checksum and the RANKED most frequent shingles of crowded
classes comes to the driver; shingles beyond those count as rare, which costs
time but no link. Ids are broadcast only
if there are at most BROADCAST_IDS of them, else the join shuffles.

Defined results: null and wordless texts have an empty set and are alone; rows
of one doc_id with different texts are documents of their own that share the id;
equal rows are copies; rows of null doc_id are alone, with null component and kept
true; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebatch as bb
from .cluster import ship, written

SHINGLE = 5
ROWS, BANDS = 4, 40
HASHES = ROWS * BANDS
BITS = 2
CROWDED = 16
MARGIN = 5
STARS, WORTH = 2, 3
RANKED = 1 << 17
BROADCAST_IDS = 500_000
_MULT = bb.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = bb.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def shingle_sets(t: bb.Texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; the whole sequence if it is shorter."""
    w = bb.words(t, bb.NON_SPACE)
    g = bb.grams(w.hashes, SHINGLE)
    out = []
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(bb.grams(w.hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(s), 512):
        h = s[k : k + 512, None] * _MULT
        h += _ADD
        np.minimum(out, h.min(0), out=out)
    return out


def bucket_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * bb.GRAM
    for k in range(ROWS):
        h = bb.mix(h ^ rows[:, k])
    return h


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 64 bits to a word."""
    each = 64 // BITS
    low = np.zeros(-(-HASHES // each) * each, np.uint64)
    low[:HASHES] = bb.mix(m) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(low.reshape(-1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def sketches(documents: DataFrame) -> DataFrame:
    names = ["row", "doc_id", "n_shingles", "h1", "h2", "bands", "bits"]

    def run(batches):
        for batch in batches:
            for t in bb.blocks(batch.column("text")):
                n, h1, h2, bands, bits = [], [], [], [], []
                for s in shingle_sets(t):
                    n.append(len(s))
                    if len(s):
                        m = minima(s)
                        h1.append(int(s.sum().view(np.int64)))
                        h2.append(int(bb.mix(s ^ bb.GRAM).sum().view(np.int64)))
                        bands.append(bucket_keys(m).view(np.int64))
                        bits.append(packed(m).view(np.int64))
                    else:
                        h1.append(0), h2.append(0), bands.append(None), bits.append(None)
                longs = pa.list_(pa.int64())
                own = [batch.column(c).slice(t.first, len(t)) for c in names[:2]]
                yield pa.record_batch([*own, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, longs), pa.array(bits, longs)], names=names)

    return documents.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, bits array<long>")


def full_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles, c): the full sets of the classes in ids (id, c)."""

    def run(batches):
        for batch in batches:
            for t in bb.blocks(batch.column("text")):
                sets = pa.array([s.view(np.int64) for s in shingle_sets(t)], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column("row").slice(t.first, len(t)), sets], names=["id", "shingles"])

    texts = documents.select("row", "text").join(few(ids.select(F.col("id").alias("row"))), "row", "left_semi").select("row", "text")
    return texts.mapInArrow(run, "id long, shingles array<long>").join(ids, "id")


def prefixes(sets: DataFrame, similarity: int) -> DataFrame:
    """(id, c, n, pos, key): the shingles of each set, rarest first, as far as a set that is similar enough must share one."""

    def count(batches):
        for batch in batches:
            keys, n = np.unique(batch.column("shingles").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    counts = sets.select("shingles").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "key").limit(RANKED).toArrow().sort_by("key")
    keys, often = (np.append(top.column(c).to_numpy(), 0).astype(np.int64) for c in ("key", "n"))

    def run(batches):
        for batch in batches:
            n, first = [], []
            for s in batch.column("shingles"):
                s = s.values.to_numpy(zero_copy_only=False)
                at = np.searchsorted(keys[:-1], s)
                order = np.lexsort((s, np.where(keys[at] == s, often[at], 0)))
                n.append(len(s))
                first.append(s[order[: len(s) + similarity * -len(s) // 100 + 1]])
            yield pa.record_batch([batch.column("id"), batch.column("c"), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["id", "c", "n", "first"])

    return sets.select("id", "c", "shingles").mapInArrow(run, "id long, c long, n long, first array<long>").select("id", "c", "n", F.posexplode("first").alias("pos", "key"))


def prefix_pairs(sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b), of different components c, that share a shingle early enough in both sets.

    One side holds only rows outside the largest component of the shingle."""
    rows = prefixes(sets, similarity)
    each = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = each.groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "most")
    rows = written(rows.join(mixed, "key"), "prefixes")
    x, y = rows.where("c <> most").alias("x"), rows.alias("y")
    need = f"-floor(-{similarity} * (x.n + y.n) / {100 + similarity}D)"
    close = f"x.key = y.key and x.c <> y.c and x.pos <= x.n - {need} and y.pos <= y.n - {need} and 100 * least(x.n, y.n) >= {similarity} * greatest(x.n, y.n)"
    return x.join(y, F.expr(close)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def estimate(a: str, b: str) -> str:
    """SQL for the collision-corrected similarity of two packed signatures."""
    even = sum(1 << k for k in range(0, 62, BITS)) | (1 << 62)  # lowest bit of every pair
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {even}L)), 0, (s, x) -> s + x)"
    return f"((1 - {differ} / {HASHES}D) - {1 / (1 << BITS)}D) / {1 - 1 / (1 << BITS)}D"


def few(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if the bound of BROADCAST_IDS holds."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def confirm(documents: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similarity * union, on the full sets."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ids")
    texts = documents.select("row", "text").join(few(ids), "row", "left_semi")
    sides = [texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]

    def run(batches):
        last, its = None, None
        for batch in batches:
            ids = batch.column("a").to_pylist()
            left, right = batch.column("text_a"), batch.column("text_b")
            keep = []
            for t in bb.blocks(right):
                for i, s in enumerate(shingle_sets(t), t.first):
                    if last is None or ids[i] != last:
                        its = shingle_sets(next(iter(bb.blocks(left.slice(i, 1)))))[0]
                        last = ids[i]
                    both = len(np.intersect1d(its, s, assume_unique=True))
                    if both and 100 * both >= similarity * (len(its) + len(s) - both):
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return pairs.select("a", "b").join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): smallest id reachable, by alternating large and small stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _stars(links: DataFrame) -> bool:
    """Whether every u has one v, and that is no u itself."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def group(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = 75, stable: bool = False, rows: bool = False) -> DataFrame:
    """Per document: set size, component (smallest doc_id reachable), and whether it is the one to keep.

    stable: `documents` is a table that gives the same rows in the same partitions when read again; others are
    written first. rows: also `row`, the monotonically increasing id of the row, and `stays`: one row of each component."""
    spark = documents.sparkSession
    ship(spark)
    if not stable:
        documents = written(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "input")
        doc_id, text = "doc_id", "text"
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    sk = written(sketches(docs), "sketches")
    classes = written(sk.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "row")).alias("least")), "classes")
    reps = sk.join(classes.select(F.col("rep").alias("row"), "h1", "h2"), ["row", "h1", "h2"], "left_semi").select(F.col("row").alias("id"), "n_shingles", "bands", "bits")
    bits = reps.select("id", "n_shingles", "bits")
    buckets = reps.select("id", F.explode("bands").alias("key")).where("key is not null")
    shared = buckets.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
    shared = written(shared, "shared")
    larger = buckets.join(shared.where("n > 2").select("key", "first", "n"), "key")
    hits = written(larger.groupBy("id").agg(F.collect_list(F.struct("key", "first", "n")).alias("at")), "buckets")

    def likely(pairs: DataFrame) -> DataFrame:
        a = bits.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bits").alias("bits_a"))
        b = bits.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bits").alias("bits_b"))
        got = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
        by_chance = 1 / (1 << BITS)
        equal = similarity / 100 * (1 - by_chance) + by_chance  # share of equal low bits at the similarity asked for
        margin = MARGIN * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - by_chance)
        return got.where(f"{estimate('bits_a', 'bits_b')} >= {similarity / 100 - margin}").select("a", "b").distinct()

    stars = hits.select("id", F.inline("at")).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    stars = written(stars.unionByName(shared.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))).distinct(), "stars")
    links = written(confirm(known, written(likely(stars), "pairs"), similarity), "confirmed")
    found = written(components(links), "components")

    def labels() -> DataFrame:
        """(id, c, at): the component and the buckets of each class; a bucket of two was dealt with by its star."""
        return written(hits.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("c"), "at"), "labels")

    label = labels()
    for r in range(STARS):
        rest = label.select("id", "c", F.inline("at"))
        each = rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min_by("id", F.xxhash64("id", F.lit(r))).alias("who"))
        most = F.max(F.struct("m", "who", "c")).alias("most")
        centres = each.groupBy("key").agg(most, F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count(F.lit(1)).alias("k"))
        centres = written(centres.where("k > 1").select("key", "n", "same", F.col("most.who").alias("who"), F.col("most.c").alias("other")), "centres")
        cost = centres.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if (cost[0] or 0) <= WORTH * (cost[1] or 0):
            break
        spokes = rest.alias("x").join(centres.alias("y"), F.expr("x.key = y.key and c <> other"))
        spokes = written(likely(spokes.select(F.least("id", "who").alias("a"), F.greatest("id", "who").alias("b")).distinct()), "pairs")
        new = written(confirm(known, spokes, similarity), "confirmed")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found = written(components(links), "components")
        label = labels()
    rest = label.select("id", "c", F.inline("at"))
    x, y = (rest.where(f"n <= {CROWDED}").select("key", F.col("id").alias(i), F.col("c").alias(f"c_{i}")) for i in "ab")
    more = x.join(y, "key").where("a < b and c_a <> c_b").select("a", "b")
    held = rest.where(f"n > {CROWDED}").select("key", "id", "c")
    mixed = held.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("key")
    crowded = written(held.join(mixed, "key", "left_semi").select("id", "c").distinct(), "crowded")
    if not crowded.isEmpty():
        sets = written(full_sets(known, crowded), "sets")
        more = more.unionByName(prefix_pairs(sets, similarity))
    more = written(likely(more.distinct().join(stars, ["a", "b"], "left_anti")), "pairs")
    if not more.isEmpty():
        links = links.unionByName(confirm(known, more, similarity))
        found = written(components(links), "components")

    heads = found.select(F.col("component").alias("id")).distinct().select("id", F.col("id").alias("component"))
    low = classes.select(F.col("rep").alias("id"), "least").join(found.unionByName(heads), "id").groupBy("component").agg(F.min("least").alias("joined"))
    low = found.unionByName(heads).join(low, "component").select(F.col("id").alias("rep"), "joined")
    named = classes.join(low, "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("joined", "least").alias("first"))
    out = sk.select("row", "doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", F.struct("doc_id", "row")))
    out = out.select("row", "doc_id", "n_shingles", first.alias("first"))
    out = out.select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("stays"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *["row", "stays"] * rows)
