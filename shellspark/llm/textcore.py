"""Vectorised views of text columns: byte slices, token spans and rolling hashes.

The functions work on Arrow string columns inside ``mapInArrow``.  A batch is cut into slices of about
``SLICE`` bytes, so that the working memory of a task does not depend on the size of its input; a single
longer text is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[list(WHITE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and digits and every byte of a longer UTF-8 sequence.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def same(a: str, b: str) -> bool:
    """Are these one column's name to Spark?"""
    return a.lower() == b.lower()


def others(columns: list[str], *results: str) -> list[str]:
    """The columns that no result replaces."""
    return [c for c in columns if not any(same(c, r) for r in results)]


def free(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that no given column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def kinds(df, columns: list[str]) -> str:
    """The columns' part of a schema in DDL."""
    return ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in columns)


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values together and the offsets of each."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, at least one row each."""
    _, offsets = raw(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, never across rows: starts, ends, first run of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[data]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    s[first], e[last] = w[first], w[last]
    starts = np.flatnonzero(s)
    return starts, np.flatnonzero(e) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges from one running sum over the data.

    hash(b) = sum of T[b_i] * P^i (mod 2^64), P odd, so the sum over a range can be moved to position 0 with
    the inverse of P.  T is drawn from ``seed``; different seeds give independent hashes.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.p = np.uint64(int(rng.integers(0, 1 << 61)) * 8 + 5)
        self.q = np.uint64(pow(int(self.p), -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 18)
            n += n // 4
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.p))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.q))])

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same over 64-bit values in place of bytes."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` values; shorter by n - 1 than ``h``, across rows too (the caller masks those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    g = np.full(m, np.uint64(seed))
    for k in range(n):
        g = mix(g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m])
    return g


def inside_rows(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each value of ngrams(): does it lie within one row? bounds: as from spans()."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
    return left[: total - n + 1] >= n


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranges of ``values`` put end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    run = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return run[bounds[1:]] - run[bounds[:-1]]
