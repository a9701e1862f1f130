"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Texts are handled in blocks of a few megabytes, so memory follows the block
size (or the longest single text) and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
GRAM = U64(0xD6E8FEB86659FD93)
LIMIT = 1 << 18

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` and `[^\x20\x09-\x0D]+`.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NON_SPACE = byte_class(set(range(256)) - {0x20, *range(0x09, 0x0E)})


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 64), base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if n <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


class Texts:
    """Consecutive rows' bytes: `data`, with row i at data[offs[i]:offs[i + 1]]."""

    __slots__ = ("first", "data", "offs")

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray):
        self.first, self.data, self.offs = first, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def give_back() -> None:
    """Returns what Arrow's pool keeps of freed batches, some 50 MB a worker, to the system."""
    pa.default_memory_pool().release_unused()


def blocks(col, limit: int = LIMIT) -> Iterator[Texts]:
    """Rows of a string column in blocks of about `limit` bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), len(col))
        yield Texts(i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j
    give_back()


class Words:
    """Words of a block: byte spans, 64-bit hashes, and offs[i] the first word of row i."""

    __slots__ = ("starts", "ends", "hashes", "offs")


def words(t: Texts, kind: np.ndarray) -> Words:
    """Words of lower-cased (A-Z) text made of the bytes in `kind`."""
    w = Words()
    low = LOWER[t.data]
    n = len(low)
    mask = kind[low]
    begins = mask.copy()
    stops = mask.copy()
    if n:
        begins[1:] &= ~mask[:-1]
        stops[:-1] &= ~mask[1:]
        edge = t.offs[(t.offs > 0) & (t.offs < n)]
        begins[edge] = mask[edge]
        stops[edge - 1] = mask[edge - 1]
    w.starts = np.flatnonzero(begins)
    w.ends = np.flatnonzero(stops) + 1
    lens = w.ends - w.starts
    w.offs = np.searchsorted(w.starts, t.offs)
    if not len(lens):
        w.hashes = np.zeros(0, U64)
        return w
    first = np.cumsum(lens) - lens
    inside = low[mask].astype(U64)
    inside += U64(1)
    inside *= powers(MULT, int(lens.max()))[np.arange(len(inside)) - np.repeat(first, lens)]
    w.hashes = mix(np.add.reduceat(inside, first) + lens.astype(U64) * GRAM)
    return w


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i, across row ends as well; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    p = powers(GRAM, k)
    for j in range(1, k):
        out += hashes[j : j + n] * p[j]
    return mix(out)


def inside_rows(offs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n starts have k items before their row ends."""
    ok = np.ones(n, dtype=bool)
    for back in range(1, k):
        at = offs[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        # a start within k - 1 of a row's end crosses it, in whichever row it lies
        ok[at] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w]; len(x) - w + 1 of them."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have :]) if have < w else out


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """Maximum of x[i:i+w]; len(x) - w + 1 of them."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.maximum(out[:-have], out[have:])
        have *= 2
    return np.maximum(out[: len(x) - w + 1], out[w - have :]) if have < w else out


def minimizers(x: np.ndarray, w: int) -> np.ndarray:
    """Mask of the x[i] that are the minimum of some window of w values (ties included)."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    if len(x) < w:
        return x == x.min()
    low = sliding_min(x, w)
    pad = np.zeros(w - 1, dtype=x.dtype)
    return sliding_max(np.concatenate([pad, low, pad]), w) == x
