"""Interpolated modified Kneser-Ney n-gram model of any order: counted in Spark, stored as sorted hash arrays, memory-mapped.

Counting.  A first pass counts words; a word's id is its place in the vocabulary arrays.  In the second, tasks turn slices of text into
id n-grams with numpy, sum them for some millions of tokens at a time and send sorted, delta-coded and compressed runs to buckets.  A
bucket is merged by one task; its n-grams, by 64-bit hashes of their ids, and the statistics of their contexts become sorted
hash arrays (``hashstore``).  What the next lower order counts, the distinct words before each (n-1)-gram, are then the numbers of the merged
n-grams by suffix: a bucket sums those of its own n-grams and sends them on as runs, and so on down to single words.  Only
counts of counts and the list of buckets come to the driver.

Buckets.  All n-grams of one context must meet, and those of one suffix should.  So the bucket follows from the word before the last; if that word has
more than ``HOT`` tokens, its n-grams are cut into so many classes by the word before it that each has about ``HOT``.  Frequent n-grams are
summed before the shuffle, so no count of repetitions makes a bucket larger.

Arrays.  The top bits of a hash choose a slot of about eight entries, of the other bits 32 are kept: two n-grams of a bucket, or an n-gram
and an unseen one, are taken for one with a probability of about 2e-9, whatever the size of the corpus.  Counts are bytes; those
from 255 on are listed beside them.  A context that was seen once needs its key only.

p_n(w|ctx) = max(c(ctx w) - D_n(c), 0) / c(ctx) + (D_n(1) N_1 + D_n(2) N_2 + D_n(3) N_3+) / c(ctx) * p_n-1(w|shorter ctx), with N_k the numbers of words that
follow the context k times; c is the number of occurrences for the highest order and of distinct words before for the others; an
unseen context leaves the lower order's p.  p_1(w) = max(c(w) - D_1(c), 0) / sum of c + g / (V + 1), with V the words of the training texts and the text end;
one more word stands for all unknown ones.  Before a text stand as many start marks as the context has words.  Discounts are, for each order,
the closed forms from the counts of counts one to four, held between 0.05 and the count; where one of these counts is 0, all discounts of the order are 0.5.

Cases: null text is empty; an empty text is its end token; without training texts all probabilities are 1 (the one
unknown word); repeated rows count and are scored as often as they occur; other columns are not read; an id column that has a
result's name, in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

ORDER = 3
END = np.uint64(0x0E4D_0F7E_87D0_C5A1)
#: Tokens that are summed in a task before they are sent; tokens of a bucket; tokens of a word's class.
RUN, BUCKET, HOT = 4 << 20, 2 << 20, 1 << 20
#: Bytes of text that are looked up together.
PART = 2 << 20
VOCABULARY = {"key": "u8", "c": "u8"}
RUNS = "bucket int, n int, data binary"
RESULTS = ("n_tokens", "n_known", "base_score", "score", "perplexity")
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HASHER: list[tc.Hasher] = []


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more from the numbers of items with counts 1 to 4."""
    if min(n[:4]) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in enumerate(d, 1))])


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words, each text with its end, and the first token of each row."""
    if not _HASHER:
        _HASHER.append(tc.Hasher(7))
    data, offsets = tc.raw(col)
    data = tc.LOWER[data]
    starts, ends, bounds = tc.spans(data, offsets, tc.NOT_WHITE)
    return np.insert(_HASHER[0](data, starts, ends), bounds[1:], END), bounds + np.arange(len(bounds))


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each row's ids, the first word's column first."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = tc.mix(h * _MIX + c.astype(np.uint64) + np.uint64(1))
    return h


def _spread(word: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
    return hs.bucket_of(tc.mix(word.astype(np.uint64) * _MIX + part.astype(np.uint64)), bits)


def bucket_for(columns: list[np.ndarray], frequency: np.ndarray | None, model: Model) -> np.ndarray:
    """Bucket of each n-gram; frequency: tokens of the word before the last, for n-grams of three words or more."""
    bits = model.gram_bits
    if len(columns) == 1:
        return _spread(columns[0], np.zeros(1), bits)
    part = np.zeros(len(columns[0]), np.uint64)
    if len(columns) > 2:
        classes = -(-frequency.astype(np.int64) // model.hot)
        hot = classes > 1
        part[hot] = tc.mix(columns[-3][hot].astype(np.uint64) + np.uint64(7)) % classes[hot].astype(np.uint64)
    return _spread(columns[-2], part, bits)


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the n-grams by the words before the last, nearest first, then by the last; and where another begins in it."""
    by = [*columns[-2::-1], columns[-1]]
    keys = [by[k].astype(np.uint64) << np.uint64(32) | by[k + 1].astype(np.uint64) if k + 1 < len(by) else by[k] for k in range(0, len(by), 2)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _summed(columns: list[np.ndarray], count: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order with their summed counts (None: one for each row)."""
    order, first = _sorted(columns)
    total = np.diff(np.append(first, len(order))) if count is None else np.add.reduceat(count[order], first) if len(first) else count
    return [c[order[first]] for c in columns], total


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def encode(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """A sorted run: differences within equal words before, by byte, compressed; counts from 255 on behind."""
    n, parts = len(count), []
    new = np.zeros(n, bool)
    new[:1] = True
    for c in (*columns[-2::-1], columns[-1]):
        c = c.astype(np.int64)
        step = np.diff(c, prepend=0)
        parts.append(_planes(np.where(new, c, step)))
        new |= step != 0
    parts += [np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype("<u8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decode(data: bytes, n: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    new = np.zeros(n, bool)
    new[:1] = True
    by = []
    for k in range(words):
        step = np.ascontiguousarray(raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
        run = np.cumsum(step)
        first = np.flatnonzero(new)
        c = run - np.repeat(run[first] - step[first], np.diff(np.append(first, n)))
        by.append(c.astype(np.uint32))
        new[1:] |= c[1:] != c[:-1]
    count = raw[4 * n * words : (4 * words + 1) * n].astype(np.int64)
    big = np.ascontiguousarray(raw[(4 * words + 1) * n :]).view("<u8")
    count[count == 255] = big.astype(np.int64)
    return [*by[-2::-1], by[-1]], count


def _runs(columns: list[np.ndarray], count: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """A sorted run cut by bucket."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    out = []
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        own = order[a:b]
        out.append((int(bucket[own[0]]), b - a, encode([c[own] for c in columns], count[own])))
    return out


def _rows(out: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]


def _index(key: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Slots and the bits behind them of sorted hashes."""
    m = max(0, int(np.ceil(np.log2(max(1, len(key)) / 8))))
    return {f"{name}.at": np.searchsorted(_slot(key, m), np.arange((1 << m) + 1)).astype(np.uint32), f"{name}.low": _low(key, m)}


def _slot(key: np.ndarray, m: int) -> np.ndarray:
    return (key >> np.uint64(64 - m)).astype(np.int64) if m else np.zeros(len(key), np.int64)


def _low(key: np.ndarray, m: int) -> np.ndarray:
    return ((key << np.uint64(m)) >> np.uint64(32)).astype(np.uint32)


def _small(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    big = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}.big_at": big.astype(np.uint32), f"{name}.big": values[big].astype(np.uint64)}


def _find(arrays: dict, name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash and whether it is there."""
    at, low = arrays[f"{name}.at"], arrays[f"{name}.low"]
    m = (len(at) - 1).bit_length() - 1
    slot, wanted = _slot(key, m), _low(key, m)
    a, end = at[slot].astype(np.int64), at[slot + 1].astype(np.int64)
    b, last = end.copy(), max(0, len(low) - 1)
    while len(low) and (a < b).any():
        mid = (a + b) // 2
        less = (low[np.minimum(mid, last)] < wanted) & (a < b)
        a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
    found = a < end
    found[found] = low[a[found]] == wanted[found]
    return a, found


def _value(arrays: dict, name: str, at: np.ndarray) -> np.ndarray:
    x = arrays[name][at].astype(np.int64)
    if (big := x == 255).any():
        x[big] = arrays[f"{name}.big"][np.searchsorted(arrays[f"{name}.big_at"], at[big])]
    return x


@dataclass
class Model:
    """A fitted model: where its arrays are, and the few numbers that all workers need."""

    path: str
    order: int = ORDER
    bits: int = 0
    gram_bits: int = 0
    hot: int = HOT
    first_id: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    tokens: int = 0
    words: int = 0
    #: By order: number of n-grams, counts of counts one to four, discounts, buckets that have a file.
    grams: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)
    d: dict = field(default_factory=dict)
    full: dict = field(default_factory=dict)

    def vocabulary(self) -> hs.Store:
        return hs.Store(f"{self.path}/words", self.bits, VOCABULARY)

    def ids(self, store: hs.Store, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (from 1; unknown: -1) and counts of sorted distinct word hashes."""
        ids, c = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for bucket, part, at, found in store.parts(h):
            own = np.arange(part.start, part.stop)[found]
            ids[own] = self.first_id[bucket] + at[found]
            c[own] = store.column(bucket, "c")[at[found]]
        return ids, c

    def frequency(self, store: hs.Store, ids: np.ndarray) -> np.ndarray:
        """Tokens of words by id (start mark: 0)."""
        own, inverse = np.unique(ids.astype(np.int64), return_inverse=True)
        out = np.zeros(len(own), np.int64)
        bucket = np.searchsorted(self.first_id, own, "right") - 1
        for b in np.unique(bucket[own > 0]):
            mine = np.flatnonzero((bucket == b) & (own > 0))
            out[mine] = store.column(int(b), "c")[own[mine] - self.first_id[b]]
        return out[inverse]

    def file(self, order: int, bucket: int) -> str:
        return f"{self.path}/{order}/{bucket:06d}"


def _before(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The id before each token; 0 before the first of a row."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = 0
    return before


def _columns(ids: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, first word first."""
    out = [ids]
    for _ in range(order - 1):
        out.insert(0, _before(out[0], bounds))
    return out


def _contexts(columns: list[np.ndarray], count: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the contexts of sorted n-grams: of those seen once the key, of others also c(ctx) and N_1, N_2, N_3+."""
    new = np.zeros(len(count), bool)
    new[:1] = True
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    total, *n = (np.add.reduceat(x.astype(np.int64), first) for x in (count, count == 1, count == 2, count >= 3))
    key = gram_hash([c[first] for c in columns[:-1]])
    once = total == 1
    many = np.flatnonzero(~once)
    many = many[np.argsort(key[many])]
    out = _index(np.sort(key[once]), "once") | _index(key[many], "many")
    for name, x in zip(("total", "n1", "n2", "n3"), (total, *n), strict=True):
        out |= _small(x[many], name)
    return out


def _level(model: Model, order: int, table: pa.Table) -> pa.Table:
    """Merge a bucket's runs of n-grams, write its arrays, and make the runs of the next lower order and statistics (bucket -1)."""
    bucket = table["bucket"][0].as_py()
    if bucket < 0:
        by: dict[int, list] = {}
        for k, x in zip(table["n"].to_pylist(), table["data"].to_pylist(), strict=True):
            by.setdefault(k, []).append(np.frombuffer(x, np.int64))
        out = [(-1, k, np.concatenate([np.sum([x[:5] for x in xs], axis=0), *(x[5:] for x in xs)]).tobytes()) for k, xs in by.items()]
        return pa.table(_rows(out), ["bucket", "n", "data"])
    runs = [decode(x.as_buffer(), n, order) for n, x in zip(table["n"].to_pylist(), table["data"], strict=True)]
    columns, count = _summed([np.concatenate([r[0][k] for r in runs]) for k in range(order)], np.concatenate([r[1] for r in runs]))
    del runs
    key = gram_hash(columns)
    by_key = np.argsort(key)
    arrays = _index(key[by_key], "gram") | _small(count[by_key], "c")
    if order > 1:
        arrays |= _contexts(columns, count)
    hs.put_arrays(model.file(order, bucket), arrays)
    seen = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
    out = [(-1, order, np.array([*seen, len(count), bucket], np.int64).tobytes())]
    if order > 1:
        lower, n = _summed(columns[1:], None)
        frequency = model.frequency(model.vocabulary(), lower[-2]) if order > 3 else None
        out += _runs(lower, n, bucket_for(lower, frequency, model))
    return pa.table(_rows(out), ["bucket", "n", "data"])


def _merge(model: Model, order: int):
    def level(table: pa.Table) -> pa.Table:
        return _level(model, order, table)

    return level


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _words(texts: DataFrame, model: Model) -> None:
    """Count the words of all texts and write the vocabulary."""
    path, bits = model.path, model.bits

    def sent(held: list) -> pa.RecordBatch:
        key, count = _merged(*map(list, zip(*held, strict=True)))
        edge = np.searchsorted(hs.bucket_of(key, bits), np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(edge))
        parts = [[x[edge[b] : edge[b + 1]].tobytes() for b in full] for x in (key, count.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], ["bucket", "keys", "counts"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            col = tc.text_column(batch, "text")
            for i, j in tc.slices(col, PART):
                held.append(np.unique(_tokens(col.slice(i, j - i))[0], return_counts=True))
                n += len(held[-1][0])
                if n >= RUN:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def write(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        counts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) for x in table["counts"]]
        key, c = _merged([np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]], counts)
        hs.put(f"{path}/words/{bucket:05d}.key", key)
        hs.put(f"{path}/words/{bucket:05d}.c", c)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "rows": [len(key)], "total": [int(c.sum())]})

    runs = texts.mapInArrow(count_words, "bucket int, keys binary, counts binary")
    got = runs.groupBy("bucket").applyInArrow(write, "bucket int, rows long, total long").collect()
    for b in set(range(1 << bits)) - {r.bucket for r in got}:
        for name, kind in VOCABULARY.items():
            hs.put(f"{path}/words/{b:05d}.{name}", np.zeros(0, kind))
    rows = np.zeros(1 << bits, np.int64)
    rows[[r.bucket for r in got]] = [r.rows for r in got]
    model.first_id = 1 + np.cumsum(rows) - rows
    model.tokens, model.words = sum(r.total for r in got), int(rows.sum())
    if model.words >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, bucket: int = BUCKET, hot: int = HOT) -> Model:
    """Count the model over all rows of ``docs`` and write it to the shared folder."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    model = Model(hs.shared_dir(spark, "kneser-ney"), order, hot=hot, bits=hs.bits_for(size // 64) if size < 1 << 60 else 6)
    _words(texts, model)
    if not model.tokens:
        return model
    bits = model.gram_bits = hs.bits_for(model.tokens, bucket)

    def run(held: list) -> pa.RecordBatch:
        *columns, frequency = (np.concatenate(x) for x in zip(*held, strict=True))
        at, first = _sorted(columns)
        count, own = np.diff(np.append(first, len(at))), at[first]
        columns = [c[own] for c in columns]
        return pa.RecordBatch.from_arrays(_rows(_runs(columns, count, bucket_for(columns, frequency[own], model))), ["bucket", "n", "data"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held, n = model.vocabulary(), [], 0
        for batch in batches:
            col = tc.text_column(batch, "text")
            for i, j in tc.slices(col, PART):
                h, bounds = _tokens(col.slice(i, j - i))
                words, inverse = np.unique(h, return_inverse=True)
                ids, c = model.ids(store, words)
                ids = ids[inverse].astype(np.uint32)
                held.append([*_columns(ids, bounds, order), _before(np.minimum(c[inverse], (1 << 32) - 1).astype(np.uint32), bounds)])
                n += len(ids)
                if n >= RUN:
                    yield run(held)
                    held, n = [], 0
        if held:
            yield run(held)

    runs = texts.mapInArrow(count_grams, RUNS)
    for k in range(order, 0, -1):
        runs = runs.groupBy("bucket").applyInArrow(_merge(model, k), RUNS)
    for r in runs.collect():
        x = np.frombuffer(r.data, np.int64)
        model.seen[r.n], model.grams[r.n] = x[:4].tolist(), int(x[4])
        model.full[r.n] = np.zeros(1 << bits, bool)
        model.full[r.n][x[5:]] = True
    model.d = {k: discounts(n) for k, n in model.seen.items()}
    return model


class _Reader:
    """The model's arrays, opened when they are first needed."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def bucket(self, order: int, bucket: int) -> dict | None:
        if not self.model.full[order][bucket]:
            return None
        if (order, bucket) not in self.open:
            self.open[order, bucket] = hs.arrays(self.model.file(order, bucket))
        return self.open[order, bucket]

    def each(self, order: int, bucket: np.ndarray):
        """The arrays of each bucket and the rows that are in it."""
        rows = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[rows], prepend=-1))
        for a, b in zip(edge, np.append(edge[1:], len(rows)), strict=True):
            if (arrays := self.bucket(order, int(bucket[rows[a]]))) is not None:
                yield arrays, rows[a:b]

    def counts(self, columns: list[np.ndarray], key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for arrays, rows in self.each(len(columns), bucket):
            at, found = _find(arrays, "gram", key[rows])
            out[rows[found]] = _value(arrays, "c", at[found])
        return out

    def contexts(self, order: int, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """c(ctx), N_1, N_2 and N_3+ of contexts of n-grams of this order, by column."""
        out = np.zeros((4, len(key)), np.int64)
        for arrays, rows in self.each(order, bucket):
            _, once = _find(arrays, "once", key[rows])
            out[0, rows[once]] = out[1, rows[once]] = 1
            at, found = _find(arrays, "many", key[rows])
            for k, name in enumerate(("total", "n1", "n2", "n3")):
                out[k, rows[found]] = _value(arrays, name, at[found])
        return out


def probabilities(model: Model, reader: _Reader, ids: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """p of each token after the tokens before it in its row; ids: -1 for unknown words; c: the words' tokens in training."""
    words, inverse = np.unique(ids, return_inverse=True)
    known = words > 0
    a = np.zeros(len(words), np.int64)
    one = [words[known]]
    a[known] = reader.counts(one, gram_hash(one), bucket_for(one, None, model))
    total, d = model.grams[2], model.d[1]
    rest = model.grams[1] - sum(model.seen[1][:2])
    g = float(d[1:] @ [model.seen[1][0], model.seen[1][1], rest]) / total
    p = (np.maximum(a - d[np.minimum(a, 3)], 0) / total + g / (model.words + 1))[inverse]
    columns, frequency = _columns(ids, bounds, model.order), _before(c, bounds)
    for order in range(2, model.order + 1):
        own, d = columns[model.order - order :], model.d[order]
        seen = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in own[:-1]]))
        if not len(seen):
            break
        key = gram_hash([x[seen] for x in own[:-1]])
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = seen[first]
        bucket = bucket_for([x[at] for x in own], frequency[at], model)
        total, *n = reader.contexts(order, key[first], bucket)[:, back]
        some = total > 0
        seen, total, n = seen[some], total[some], [x[some] for x in n]
        count = np.zeros(len(seen), np.int64)
        whole = np.flatnonzero(own[-1][seen] >= 0)
        grams = [x[seen[whole]] for x in own]
        key, first, back = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
        grams = [x[first] for x in grams]
        count[whole] = reader.counts(grams, key, bucket_for(grams, frequency[seen[whole[first]]], model))[back]
        left = d[1] * n[0] + d[2] * n[1] + d[3] * n[2]
        p[seen] = (np.maximum(count - d[np.minimum(count, 3)], 0) + left * p[seen]) / total
    return p


def score(docs: DataFrame, model: Model, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id columns, n_tokens, n_known, base_score (smoothed single words), score (log10 of the text) and perplexity."""
    keep = tc.others(id_cols, *RESULTS)
    own = tc.free(keep, "text_")[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, reader = model.vocabulary(), _Reader(model)
        floor = np.log10(model.tokens + 0.1 * (model.words + 1))
        for batch in batches:
            col = tc.text_column(batch, own)
            for i, j in tc.slices(col, PART):
                h, bounds = _tokens(col.slice(i, j - i))
                vocabulary, inverse = np.unique(h, return_inverse=True)
                ids, c = model.ids(words, vocabulary)
                base = (np.log10(c + 0.1) - floor)[inverse]
                p = probabilities(model, reader, ids[inverse], c[inverse], bounds) if model.tokens else np.ones(len(h))
                size = np.diff(bounds)
                scores = [np.add.reduceat(x, bounds[:-1]) for x in (base, np.log10(p))]
                out = [pa.array(size, pa.int64()), pa.array(tc.totals((c > 0)[inverse].astype(np.int64), bounds), pa.int64())]
                out += [pa.array(scores[0]), pa.array(scores[1]), pa.array(10.0 ** np.minimum(-scores[1] / size, 300))]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in keep), *out], [*keep, *RESULTS])

    kinds = "n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select(*keep, F.col(text_col).alias(own)).mapInArrow(of, ", ".join(x for x in (tc.kinds(docs, keep), kinds) if x))
