"""XTC trajectories: frames of bit-packed coordinates of unequal length, found by an index that Spark makes.

A frame has a header in XDR (big-endian) with the cell in nanometres, then, for more than nine atoms, integers at a stated precision: an atom in
full as one number of mixed radix, one flag, and after it up to some neighbours as small differences, whose size follows the data.

Index: tasks take ranges of bytes, find the first frame that begins in theirs (the magic number, the number of atoms and a whole chain of headers up to the
range's end must fit) and follow the headers; frames get their numbers from the ranges' counts.  It has a row for each frame with its
offset and cell, so choosing frames comes before any coordinate is read, and the cells are read without coordinates.  In a frame only the
flags are followed one after another; all numbers are then unpacked at once by numpy.

A folder of files is one trajectory in the order of their names.  A file that ends within a frame, or with anything else between frames, is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..plans.staging import settled
from . import files
from .scan import Scan, chosen

#: Fixed values of the format: magic numbers of frames (the second has 64-bit lengths), and the ranges of small differences.
MAGIC, MAGIC_LONG, FIRST = 1995, 2023, 9
RANGES = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250,
    4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287,
    660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)
NM = 10.0  # Å
HEADER, RANGE_BYTES = 96, 64 << 20


def frame_size(head: bytes) -> tuple[int, int] | None:
    """Number of atoms and bytes of a frame by its first HEADER bytes (None: no frame begins like this)."""
    if len(head) < 56:
        return None
    magic, n = struct.unpack(">2i", head[:8])
    if magic not in (MAGIC, MAGIC_LONG) or n < 0 or struct.unpack(">i", head[52:56])[0] != n:
        return None
    if n <= 9:
        return n, 56 + 12 * n
    wide = magic == MAGIC_LONG
    if len(head) < 92 + 4 * wide:
        return None
    size = struct.unpack(">q" if wide else ">i", head[88 : 96 if wide else 92])[0]
    return (n, 92 + 4 * wide + size + -size % 4) if size >= 0 else None


def _follow(f, at: int, end: int, length: int, n_atoms: int) -> list[tuple[int, int, bytes]] | None:
    """Frames that begin from ``at`` to before ``end`` (offset, size, header); None if a header does not fit."""
    out = []
    while at < min(end, length):
        f.seek(at)
        head = f.read(HEADER)
        got = frame_size(head)
        if got is None or got[0] != n_atoms or at + got[1] > length:
            return None
        out.append((at, got[1], head))
        at += got[1]
    return out


def frames_of(f, start: int, end: int, length: int, block: int = 4 << 20) -> list[tuple[int, int, bytes]]:
    """Frames that begin in a range of bytes."""
    f.seek(0)
    first = frame_size(f.read(HEADER))
    if first is None:
        raise ValueError("not an XTC file")
    if start == 0:
        out = _follow(f, 0, end, length, first[0])
        if out is None:
            raise ValueError("the file has a broken or an incomplete frame")
        return out
    marks = [struct.pack(">2i", magic, first[0]) for magic in (MAGIC, MAGIC_LONG)]
    at = start + -start % 4
    while at < end:
        f.seek(at)
        raw = f.read(min(block, end - at) + 7)
        hits = sorted(k for mark in marks for k in _all(raw, mark) if k % 4 == 0 and at + k < end)
        for k in hits:
            out = _follow(f, at + k, max(end, at + k + 1), length, first[0])
            # One header could be chance inside packed bytes; a chain to the range's end, or one more frame, is not.
            if out and (len(out) > 1 or at + k + out[-1][1] == length or _follow(f, at + k, at + k + out[-1][1] + 1, length, first[0])):
                return out
        at += block
    return []


def _all(raw: bytes, mark: bytes) -> Iterator[int]:
    k = raw.find(mark)
    while k >= 0:
        yield k
        k = raw.find(mark, k + 1)


def _bytes_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bits from each bit offset."""
    byte, shift = at >> 3, at & 7
    return ((raw[byte].astype(np.int64) << 8 | raw[byte + 1]) >> (8 - shift)) & 255


def _plain(raw: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits, highest first."""
    out = np.zeros(len(at), np.int64)
    for k in range(0, bits, 8):
        own = min(8, bits - k)
        out = out << own | _bytes_at(raw, at + k) >> (8 - own)
    return out


def _triples(raw: np.ndarray, at: np.ndarray, bits: int, sizes: tuple[int, int, int]) -> np.ndarray:
    """Three numbers below ``sizes`` that are one number of ``bits`` bits, lowest byte first, by long division."""
    parts = [_bytes_at(raw, at + k) >> (8 - min(8, bits - k)) for k in range(0, bits, 8)]
    out = np.zeros((len(at), 3), np.int64)
    for axis in (2, 1):
        rest = np.zeros(len(at), np.int64)
        for k in reversed(range(len(parts))):
            rest = rest << 8 | parts[k]
            parts[k] = rest // sizes[axis]
            rest -= parts[k] * sizes[axis]
        out[:, axis] = rest
    for k, part in enumerate(parts[:7]):
        out[:, 0] |= part << (8 * k)
    return out


def _blocks(raw: bytes, n_atoms: int, full_bits: int, small: int) -> tuple[np.ndarray, ...]:
    """By the flags: bit offset of each full atom, how many neighbours follow, where they begin, and the index of their range."""
    full, count, begin, index = [], [], [], []
    at = seen = run = 0
    while seen < n_atoms:
        full.append(at)
        at += full_bits
        byte, shift = at >> 3, at & 7
        word = ((raw[byte] << 8 | raw[byte + 1]) >> (10 - shift)) & 63
        step = 0
        if word & 32:
            run, step = divmod(word & 31, 3)
            step -= 1
            at += 6
        else:
            at += 1
        count.append(run)
        begin.append(at)
        index.append(small)
        at += run * small
        seen += run + 1
        small += step
    if seen != n_atoms or at > 8 * len(raw):
        raise ValueError("a frame's packed numbers do not fit its atoms")
    return tuple(np.array(x, np.int64) for x in (full, count, begin, index))


def unpack(frame: bytes) -> np.ndarray:
    """Coordinates (atoms, 3) in nanometres."""
    magic, n = struct.unpack(">2i", frame[:8])
    if n <= 9:
        return np.frombuffer(frame, ">f4", 3 * n, 56).reshape(-1, 3).astype(np.float64)
    precision, *limits, small = struct.unpack(">f7i", frame[56:88])
    low, high = np.array(limits[:3], np.int64), np.array(limits[3:], np.int64)
    sizes = tuple(int(s) for s in high - low + 1)
    packed = frame[96 if magic == MAGIC_LONG else 92 :] + bytes(16)
    apart = max(sizes) > 0xFFFFFF
    each = [s.bit_length() for s in sizes]
    full_bits = sum(each) if apart else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    full, count, begin, index = _blocks(packed, n, full_bits, small)
    raw = np.frombuffer(packed, np.uint8)
    if apart:
        whole = np.stack([_plain(raw, full + sum(each[:k]), each[k]) for k in range(3)], axis=1) + low
    else:
        whole = _triples(raw, full, full_bits, sizes) + low
    # Neighbours of all blocks: differences, summed up from the full atom within each block.
    block = np.repeat(np.arange(len(full)), count)
    place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    steps = np.zeros((len(block), 3), np.int64)
    for k in np.unique(index[block]):
        own = np.flatnonzero(index[block] == k)
        size = RANGES[k]
        steps[own] = _triples(raw, begin[block[own]] + place[own] * k, int(k), (size,) * 3) - size // 2
    total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(steps, axis=0)])
    near = whole[block] + total[1:] - total[np.repeat(np.cumsum(count) - count, count)]
    # The first neighbour of a block comes before its full atom.
    out = np.empty((n, 3), np.int64)
    first = np.cumsum(count + 1) - (count + 1)
    out[first + (count > 0)] = whole
    out[first[block] + place + (place > 0)] = near
    return out / float(precision)


class _Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def plain(self, x: int, bits: int) -> None:
        self.value, self.n = self.value << bits | x, self.n + bits

    def triple(self, x: list[int], sizes: tuple, bits: int) -> None:
        number = (x[0] * sizes[1] + x[1]) * sizes[2] + x[2]
        for k in range(0, bits, 8):
            self.plain(number >> k & (1 << min(8, bits - k)) - 1, min(8, bits - k))

    def done(self) -> bytes:
        return (self.value << -self.n % 8).to_bytes(-(-self.n // 8), "big")


def pack(x: np.ndarray, cell: list[float], step: int = 0, time: float = 0.0, precision: float = 1000.0, long: bool = False) -> bytes:
    """A frame from coordinates (atoms, 3) and the cell's nine numbers, both in nanometres."""
    n = len(x)
    head = struct.pack(">3if9fi", MAGIC_LONG if long else MAGIC, n, step, time, *cell, n)
    if n <= 9:
        return head + np.asarray(x, ">f4").tobytes()
    v = np.rint(np.asarray(x, np.float64) * float(np.float32(precision))).astype(np.int64)
    low, high = v.min(axis=0), v.max(axis=0)
    sizes = tuple(int(s) for s in high - low + 1)
    apart, each = max(sizes) > 0xFFFFFF, [s.bit_length() for s in sizes]
    bits = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    rows = v.tolist()
    reach = lambda a, b: max(max(p - q, q - p + 1) for p, q in zip(a, b, strict=True))  # noqa: E731  half of a range that a difference needs
    index_of = lambda need: next((k for k in range(FIRST, len(RANGES)) if RANGES[k] // 2 >= need), len(RANGES) - 1)
    gaps = sorted(reach(rows[k], rows[k + 1]) for k in range(n - 1))
    small = start = max(FIRST, index_of(gaps[len(gaps) // 2]))
    parts, own, at, run = [], _Bits(), 0, 0
    while at < n:
        half, size = RANGES[small] // 2, RANGES[small]
        fits = lambda a, b: all(-half <= p - q < size - half for p, q in zip(a, b, strict=True))  # noqa: E731, B023
        order = [at]
        if at + 1 < n and fits(rows[at], rows[at + 1]):
            order = [at + 1, at]
            while at + len(order) < n and len(order) < 9 and fits(rows[at + len(order)], rows[order[-1]]):
                order.append(at + len(order))
        full = [p - int(q) for p, q in zip(rows[order[0]], low, strict=True)]
        if apart:
            for p, k in zip(full, each, strict=True):
                own.plain(p, k)
        else:
            own.triple(full, sizes, bits)
        till = at + len(order)
        wanted = index_of(reach(rows[till], rows[till + 1])) if till + 1 < n else small
        step_ = 0 if wanted == small else 1 if wanted > small and small + 1 < len(RANGES) else -1 if wanted < small and small > FIRST else 0
        if len(order) - 1 != run or step_:
            run = len(order) - 1
            own.plain(32 | 3 * run + step_ + 1, 6)
        else:
            own.plain(0, 1)
        before = rows[order[0]]
        for k in order[1:]:
            own.triple([p - q + half for p, q in zip(rows[k], before, strict=True)], (size,) * 3, small)
            before = rows[k]
        small += step_
        at = till
        if own.n % 8 == 0 and own.n > 4096:  # whole bytes: begin anew, so numbers stay short
            parts.append(own.done())
            own = _Bits()
    parts.append(own.done())
    packed = b"".join(parts)
    length = struct.pack(">q" if long else ">i", len(packed))
    return head + struct.pack(">f7i", precision, *low.tolist(), *high.tolist(), start) + length + packed + bytes(-len(packed) % 4)


def index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """frame, uri, offset, size, natoms and m (the cell in Å, null where there is none) of each frame, written once."""
    names = ["number", "uri", "start", "place", "offset", "size", "natoms", "m"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with files.opened(r["uri"]) as f:
                    found = frames_of(f, r["start"], r["end"], r["length"])
                cells = [[NM * v for v in struct.unpack(">9f", head[16:52])] for _, _, head in found]
                rows = [(r["number"], r["uri"], r["start"], k, at, size, struct.unpack(">i", head[4:8])[0], m if any(m) else None) for k, ((at, size, head), m) in enumerate(zip(found, cells, strict=True))]
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000], strict=True))
                    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    cut = files.ranges(spark, files.listed(spark, path, ".xtc"), range_bytes)
    found = cut.mapInArrow(of, "number int, uri string, start long, place long, offset long, size long, natoms int, m array<double>")
    return settled(files.numbered(settled(found, "xtc-frames")), "xtc-index")


def coordinates(frames: DataFrame, lastatom: int = 0) -> DataFrame:
    """frame, atom_index, x, y, z (Å) of the frames of an index, up to ``lastatom`` (0: all)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with files.opened(r["uri"]) as f:
                    f.seek(r["offset"])
                    x = NM * unpack(f.read(r["size"]))
                n = min(lastatom or len(x), len(x))
                columns = [np.full(n, r["frame"], np.int32), np.arange(1, n + 1, dtype=np.int32), *(np.ascontiguousarray(x[:n, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["frame", "atom_index", "x", "y", "z"])

    return frames.select("frame", "uri", "offset", "size").mapInArrow(of, "frame int, atom_index int, x double, y double, z double")


def scan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> Scan:
    """The trajectory; frames are chosen in the index."""
    rows = index(spark, path, range_bytes)
    info = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size")).first()
    cells = rows.select("frame", "m").withColumn("volume", geo.volume(F.col("m")))

    def read(first: int, last: int, stride: int, lastatom: int) -> DataFrame:
        n = len(range(first, min(last, info.n) + 1 if last >= 0 else info.n + 1, stride))
        return coordinates(files.spread(rows.where(chosen(first, last, stride)), spark, info["size"] or 0, n), lastatom)

    return Scan(cells, read)


def write(coords: DataFrame, cells: DataFrame, path: str, precision: float = 1000.0, frames_per_file: int = 8) -> None:
    """Write frames (coordinates and cells in Å) as a folder of files, each by one task."""
    span = F.floor((F.col("frame") - 1) / frames_per_file).cast("int").alias("span")

    def of(key, own: pa.Table, box: pa.Table) -> pa.Table:
        own = own.sort_by([("frame", "ascending"), ("atom_index", "ascending")])
        frame = own["frame"].to_numpy()
        x = np.stack([own[c].to_numpy() for c in "xyz"], axis=1) / NM
        cell = {r["frame"]: [v / NM for v in r["m"]] if r["m"] else [0.0] * 9 for r in box.to_pylist()}
        at = np.flatnonzero(np.diff(frame, prepend=-1))
        parts = [pack(part, cell[int(frame[a])], int(frame[a]), float(frame[a]), precision) for a, part in zip(at, np.split(x, at[1:]), strict=True)]
        files.put(f"{path}/part-{key[0].as_py():010d}.xtc", *parts)
        return pa.table({"n": pa.array([len(parts)], pa.int64())})

    left = coords.select(span, "frame", "atom_index", "x", "y", "z").groupBy("span")
    left.cogroup(cells.select(span, "frame", "m").groupBy("span")).applyInArrow(of, "n long").collect()  # a number for each file
