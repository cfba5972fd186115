"""Benchmark decontamination: test items found in documents within an edit budget.

Items and documents are compared as lower-cased words of letters and digits.  An item of n words may differ in
e = floor(rate * n) words (put in, left out or replaced), so of its e + 1 pieces at least one occurs unchanged
(pigeonhole).  Piece hashes are looked up at every word of every text; each hit is verified by Myers' bit-parallel
distance of the whole item to the words around the hit.  The search is exact: no item or hit is left out.

Items and their pieces are written by Spark as stores in the shared folder: the pieces' hashes sorted, with a bitmap that most words of a text
fail, and the items' words beside them in Arrow files.  Workers map them, so the documents are read once whatever the items'
size, nothing is broadcast or sent to the driver, and a task holds only what it touches.

Cases: null texts are empty; an item without words fits nothing; items of fewer than 1/rate words are matched unchanged; equal
texts under different ids are all reported, repeated items once; an empty table gives an empty table.  Hits come as one array column whose name is a
parameter; a column of that name in the input, in any case, is replaced.  Item ids may be of any type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashstore as hs
from . import textcore as tc

RATE = 0.2
#: Bytes of items in one file of their words.
ITEM_BYTES = 4 << 20
HIT = "struct<item_id: {}, errors: int, start_word: int, end_word: int>"
_H: list[tc.Hasher] = []


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the first word of each row."""
    if not _H:
        _H.append(tc.Hasher(11))
    starts, ends, bounds = tc.spans(data, offsets, tc.ALNUM)
    return _H[0](tc.LOWER[data], starts, ends), bounds


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


def pieces(n: int, rate: float) -> tuple[int, list[tuple[int, int]]]:
    """Error budget of an item of n words, and (start, length) of its budget + 1 pieces, as even as can be."""
    e = int(np.floor(rate * n + 1e-9))
    edge = [n * k // (e + 1) for k in range(e + 2)]
    return e, [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def nearest(item: list, text: list, most: int) -> tuple[int, int]:
    """Least edit distance of ``item`` to a run of ``text``, and the end of the first such run; (most + 1, 0) if none is within ``most``.

    Myers' algorithm: column differences of the distance table as the bits of two integers.
    """
    n = len(item)
    where: dict = defaultdict(int)
    for k, w in enumerate(item):
        where[w] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, d, best, end = full, 0, n, most + 1, 0
    if n <= most:
        best, end = n, 0
    for k, w in enumerate(text):
        eq = where.get(w, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(zero | up))
        left = up & zero
        d += (right & top > 0) - (left & top > 0)
        right, left = (right << 1) & full, (left << 1) & full
        up = left | (full & ~(zero | right))
        down = right & zero
        if d < best:
            best, end = d, k + 1
    return best, end


class Items:
    """The stores that ``written`` makes, opened where a worker first needs them."""

    def __init__(self, path: str, bits: int, slots: int, lengths: list[int]):
        self.path, self.bits, self.slots, self.lengths, self.open = path, bits, slots, lengths, {}

    def _of(self, name: str, make):
        if name not in self.open:
            self.open[name] = make(f"{self.path}/{name}")
        return self.open[name]

    def words(self, item: int) -> np.ndarray:
        return self._table(item)["words"][item & 0xFFFFFFFF].values.to_numpy()

    def ids(self, items: list[int], kind: pa.DataType) -> pa.Array:
        return pa.array([self._table(k)["item_id"][k & 0xFFFFFFFF].as_py() for k in items], kind)

    def _table(self, item: int):
        read = lambda uri: pa.ipc.open_file(pa.py_buffer(hs.mapped(uri, "u1"))).read_all().combine_chunks().to_batches()[0]
        return self._of(f"words/{item >> 32:08d}", read)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are a piece's, its item, and the piece's start in it; a row for each piece."""
        bucket = hs.bucket_of(keys, self.bits)
        slot = ((keys << np.uint64(self.bits)) >> np.uint64(64 - self.slots)).astype(np.int64)
        out = [(np.zeros(0, np.int64),) * 3]
        for b in range(1 << self.bits):
            own = np.flatnonzero(bucket == b) if self.bits else np.arange(len(keys))
            own = own[self._of(f"maps/{b:05d}", lambda uri: hs.mapped(uri, "u1"))[slot[own]] > 0]
            if not len(own):
                continue
            key, item, start = (self._of(f"pieces/{b:05d}.{c}", lambda uri, kind=kind: hs.mapped(uri, kind)) for c, kind in (("key", "u8"), ("item", "i8"), ("start", "i8")))
            low, high = np.searchsorted(key, keys[own]), np.searchsorted(key, keys[own], "right")
            at = tc.gather(np.arange(len(key)), low, high - low)
            out.append((np.repeat(own, high - low), item[at], start[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def piece_key(h: np.ndarray, length: int) -> np.ndarray:
    return tc.mix(h + np.uint64(length) * np.uint64(0x9E3779B97F4A7C15))


def written(items: DataFrame, rate: float, item_bytes: int = ITEM_BYTES) -> Items:
    """Items (item_id, text), each once, as stores."""
    spark, path = items.sparkSession, hs.shared_dir(items.sparkSession, "items")
    items = items.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    files = max(1, -(-total // item_bytes))

    def of(table: pa.Table) -> pa.Table:
        number = table["file"][0].as_py()
        col = tc.text_column(table, "text")
        order = np.array(sorted(range(len(col)), key=lambda k: (repr(table["item_id"][k].as_py()), col[k].as_py())), np.int64)
        words, bounds = _words(*tc.raw(col.take(pa.array(order))))
        own = pa.table({"item_id": table["item_id"].take(pa.array(order)), "words": pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(words))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, own.schema) as f:
            f.write_table(own.combine_chunks(), max_chunksize=max(1, len(own)))
        hs.put(f"{path}/words/{number:08d}", sink.getvalue().to_pybytes())
        rows = []
        for k in range(len(col)):
            h = words[bounds[k] : bounds[k + 1]]
            for start, length in pieces(len(h), rate)[1]:
                if length:
                    rows.append((int(piece_key(tc.ngrams(h[start : start + length], length), length).view(np.int64)[0]), number << 32 | k, start, length))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("key", "item", "start", "length"), columns, strict=True)})

    filed = items.withColumn("file", F.pmod(F.xxhash64("item_id", "text"), F.lit(files)).cast("int"))
    filed.groupBy("file").applyInArrow(of, "key long, item long, start long, length long").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lengths = sorted(r.length for r in rows.select("length").distinct().collect())  # fewer than 1 / rate + 1
    count = rows.count()
    bits = hs.write(rows.select("key", "item", "start"), f"{path}/pieces")
    slots = int(min(24, max(12, np.ceil(np.log2(max(1, count / (1 << bits)))) + 5)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                key = hs.mapped(f"{path}/pieces/{b:05d}.key", "u8")
                own = np.zeros(1 << slots, np.uint8)
                own[((key << np.uint64(bits)) >> np.uint64(64 - slots)).astype(np.int64)] = 1
                hs.put(f"{path}/maps/{b:05d}", own)
            yield batch

    spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(mark, "id long").count()
    hs.remove(spark, f"{path}/rows")
    return Items(path, bits, slots, lengths)


def find(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    into: str = "hits",
    keep: list[str] | None = None,
    rate: float = RATE,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Columns ``keep`` (all, if not given) and ``into``: the items found in the text, each with its least distance and place: the first run of
    words with that distance, and of those that end there the shortest."""
    keep = tc.others(docs.columns if keep is None else keep, into)
    text, hits = tc.free([*keep, into], "text_", "hits_")
    kind = items.schema["item_id"].dataType
    hit = pa.struct([("item_id", to_arrow_type(kind)), ("errors", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32())])
    own = written(items, rate, item_bytes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tc.text_column(batch, text)
            for i, j in tc.slices(col):
                found = _found(*_words(*tc.raw(col.slice(i, j - i))), own, rate)
                rows = sorted(found)
                fields = [own.ids([item for _, item in rows], hit.field(0).type), *(pa.array([found[r][k] for r in rows], pa.int32()) for k in range(3))]
                first = np.searchsorted(np.array([row for row, _ in rows], np.int64), np.arange(j - i + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(fields, fields=list(hit)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), spans], [*keep, hits])

    ddl = ", ".join(x for x in (tc.kinds(docs, keep), f"`{hits}` array<{HIT.format(kind.simpleString())}>") if x)
    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(of, ddl).select(*keep, F.col(hits).alias(into))


def _found(words: np.ndarray, bounds: np.ndarray, items: Items, rate: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """By row and item: errors, first word and end."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, item, start in sorted(_candidates(words, bounds, items)):
        own = items.words(item)
        n, e = len(own), pieces(len(own), rate)[0]
        a, b = max(bounds[row], start - e), min(bounds[row + 1], start + n + e)
        near = words[a:b].tolist()
        errors, end = nearest(own.tolist(), near, e)
        if errors <= e:
            # No run that ends earlier is as near, so backwards from here the item is met where the run begins.
            back = nearest(own[::-1].tolist(), near[:end][::-1], e)[1]
            place = (errors, int(a + end - back - bounds[row]), int(a + end - bounds[row]))
            out[row, item] = min(place, out.get((row, item), place), key=lambda p: (p[0], p[2], -p[1]))
    return out


def _candidates(words: np.ndarray, bounds: np.ndarray, items: Items) -> set[tuple[int, int, int]]:
    """(row, item, word at which the item would begin) of each piece found."""
    out = set()
    for length in items.lengths:
        g = tc.ngrams(words, length)
        at, item, start = items.hits(piece_key(g, length))
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + length <= bounds[row + 1]
        out.update(zip(row[inside].tolist(), item[inside].tolist(), (at - start)[inside].tolist(), strict=True))
    return out
