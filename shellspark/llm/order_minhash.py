"""Near-duplicate texts by Order MinHash, verified by banded alignment.

Texts are compared as lower-cased words of letters and digits.  A shingle is five words, labelled with how often it has
occurred before in its text.  A sketch takes, under one hash order, the least labelled shingles and keeps them in text
order, so texts with the same shingles in another order differ; a sketch is a band.

Bands follow from the edits that are accepted.  Where a share p of the words is replaced here and there, q = (1 - p)^5 of the
shingles stay, their similarity is s = q / (2 - q), and a band of two shingles is shared with a probability of about s^2.  A pair is
missed by all 80 bands with a probability of (1 - s^2)^80: 0.04 at p = 0.2, 0.001 at 0.15, below 0.000001 at 0.1.  Edits that
lie together leave more shingles.  A text of at most ``MIDDLE`` words has few shingles that scattered edits leave alone, so it has bands of
single labelled words too: with p of n words replaced, (1 - p) n of (1 + p) n words are common, so a band of three (texts of at most
``SHORT`` words) is shared with a probability of 0.2 to 0.3 at p = 0.2, and a band of five (longer ones) of 0.1 to 0.13; 32 bands each miss below
0.001 and 0.03.  Texts about the border of the two have both.

Candidates are verified by their edit distance in words, at most (1 - 0.8) of the longer text, computed in a diagonal band
that doubles until the distance fits.

Hot groups.  Texts that are equal are one node before anything is compared.  In each bucket all members are compared with
the first one; a bucket whose members are then of one class is done, so a group of near copies costs one
comparison a member.  In the buckets that are left, leaders of more and more parts of the bucket are compared with the members of other classes, and
at last all pairs of different classes that exact prefix filtering leaves are, so every pair of a bucket is decided and a passage that a
third of all texts share costs no square of their number.  These joins emit only pairs that can be within the budget by an
exact bound: one bit of a text's parity sketch flips for each labelled word, so two sketches differ in no more bits than the texts have words of their own.

Texts' words are looked up in a store of the shared folder, so no text is shuffled for a pair.

Classes are connected components by alternating large-star and small-star steps.  Every intermediate is a table in the
shared folder, deleted once it is not needed; links and labels stay distributed.

Cases: null text is empty; equal texts form a class, so empty texts do; a text of one to four words is one shingle; a null id counts as the
largest; repeated rows get equal results; other columns are not read by classes() and kept as they are by representatives(), whatever
their names.  Texts are told apart by 120 bits of their SHA-256, words by 32-bit hashes in the alignment.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

SHINGLE, TAKEN, BANDS, SIMILARITY = 5, 2, 80, 0.8
#: Bands of single words: texts of at most SHORT words, and texts from SIMILARITY times that to MIDDLE words.
SHORT, MIDDLE, WORD_BANDS, SHORT_TAKEN, MIDDLE_TAKEN = 40, 160, 32, 3, 5
#: log2 of the bits of a parity sketch, which is kept as longs.
PARITY = 11
#: Parts of a bucket with a leader each, by round.
LEADERS = (4,)
#: Rows that are looked at together, and bytes of a store's bucket.
ROWS, SHELF = 1024, 8 << 20
#: Bytes of text that are looked at together; workers of many small stages stay small.
PART = 256 << 10
#: The part of a shingle's hash by which texts with it are counted.
_TOP = np.uint64(0xFFFFFFFFFFFF0000)
_H: list[tc.Hasher] = []


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not _H:
        _H.append(tc.Hasher(23))
    data, offsets = tc.raw(col)
    starts, ends, bounds = tc.spans(data, offsets, tc.ALNUM)
    return _H[0](tc.LOWER[data], starts, ends), bounds


def _orders(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(29))
    xor, times = rng.integers(0, 1 << 32, (2, bands), dtype=np.uint32)
    return xor[:, None], (times | np.uint32(1))[:, None]


def labelled(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Shingles of one text, each hashed with the number of times it occurs before."""
    g = tc.ngrams(words, min(k, len(words)))
    order = np.argsort(g, kind="stable")
    first = np.diff(g[order], prepend=~g[order][:1]) != 0
    at = np.arange(len(g))
    seen = np.empty(len(g), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return tc.mix(g + seen * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The text's buckets, one for each band: hashes of the least labelled shingles in text order, with the band's kind and number."""
    found = [_bands(labelled(words, SHINGLE), bands, TAKEN)]
    if len(words) <= SHORT:
        found.append(_bands(labelled(words, 1), WORD_BANDS, SHORT_TAKEN))
    if SIMILARITY * SHORT <= len(words) <= MIDDLE:
        found.append(_bands(labelled(words, 1), WORD_BANDS, MIDDLE_TAKEN))
    return np.concatenate(found)


def _bands(h: np.ndarray, bands: int, taken: int) -> np.ndarray:
    xor, times = _orders(bands)
    low = (h >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 18) // max(1, len(h)))
    out = []
    for b in range(0, bands, step):
        v = (low ^ xor[b : b + step]) * times[b : b + step]
        rows = np.arange(len(v))
        at = np.empty((min(taken, len(h)), len(v)), np.int64)
        for k in range(len(at)):
            at[k] = v.argmin(axis=1)
            v[rows, at[k]] = np.uint32(0xFFFFFFFF)
        at.sort(axis=0)
        key = np.uint64(taken << 16) + np.arange(b, b + len(v)).astype(np.uint64)
        for p in at:
            key = tc.mix(key * np.uint64(0xD6E8FEB86659FD93) + h[p])
        out.append(key)
    return np.concatenate(out)


def parity(words: np.ndarray) -> np.ndarray:
    """Bits that each labelled word flips, so two texts differ in no more bits than they have words of their own."""
    flips = np.bincount((labelled(words, 1) >> np.uint64(64 - PARITY)).astype(np.int64), minlength=1 << PARITY)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


#: The longs of a parity sketch are columns: with an array's checks, the join's compiled method passes the size that a JVM optimises.
BITS = tuple(f"b{k}" for k in range((1 << PARITY) // 64))


def _limit(similarity: float):
    """Bits in which the texts of n and x_n words may differ, and in which they do by their lengths; an edit changes the difference of the bags by two at most."""
    return 2 * F.floor(F.greatest("n", "x_n") * (1 - similarity) + 1e-9), F.abs(F.col("n") - F.col("x_n"))


def _possible(similarity: float):
    """May the texts of n and x_n words be within the budget?"""
    limit, least = _limit(similarity)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x_{c}"))) for c in BITS), least)
    return (least <= limit) & (differ <= limit)


def _possible_by_array(similarity: float):
    """The same with sketches as arrays: slower, but a short method beside other conditions."""
    limit, least = _limit(similarity)
    each = F.zip_with("bits", "x_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return (least <= limit) & (F.aggregate(each, least, lambda total, n: total + n) <= limit)


def banded(a: list, b: list, most: int) -> int:
    """Edit distance of two lists if it is at most ``most``, else most + 1; only a diagonal band of 2 most + 1 is computed.

    The vertical differences in the band are the bits of two integers (Hyyro's form of Myers' algorithm), and the
    band moves down by one row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if most >= m:
        most = m - 1 if n else m
        if not n:
            return m
        if most < 1:
            return int(a != b)
    where: dict = defaultdict(int)
    for k, w in enumerate(a):
        where[w] |= 1 << k
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down, d = full & ~((1 << (width - most - 1)) - 1), 0, most
    last, shift = top >> 1, most + 1 - width
    limit = 2 * most + n - m
    for i, w in enumerate(b):
        eq = where.get(w, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        zero = ((((eq & up) + up) ^ up) | eq | down) & full
        right = (down | ~(zero | up)) & full
        left = zero & up
        if i < m - most:
            d += not zero & top
        else:
            d += bool(right & last) - bool(left & last)
            last >>= 1
        if d > limit:
            return most + 1
        zero >>= 1
        up = (left | ~(zero | right)) & full
        down = zero & right
        shift += 1
    return min(d, most + 1)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word arrays, or most + 1 if it is larger; the band doubles until it holds the distance."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b, n = a[head:], b[head:], n - head
    same = a[::-1][:n] == b[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(len(a) + len(b), most + 1)
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    spare = np.bincount(inverse[: len(a)], minlength=len(values)) - np.bincount(inverse[len(a) :], minlength=len(values))
    least = max(int(spare[spare > 0].sum()), int(-spare[spare < 0].sum()))  # words that only one of them has
    if least > most:
        return most + 1
    x, y, k = inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), min(most, max(8, least))
    while (d := banded(x, y, k)) > k and k < most:
        k = min(most, 2 * k)
    return min(d, most + 1)


def budget(n: int, m: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * max(n, m) + 1e-9))


class _Tables:
    """Numbered tables in one shared folder."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, hs.shared_dir(spark, "order-minhash"), 0

    def __call__(self, df: DataFrame, wide: bool = False) -> DataFrame:
        """``wide``: rows of some hundred bytes and more, which keep their partitions."""
        self.n += 1
        df = df if wide else hs.few(df)
        df.write.parquet(path := f"{self.path}/{self.n:04d}")
        return self.spark.read.schema(df.schema).parquet(path)

    def since(self, n: int) -> None:
        """Delete the tables written behind the n-th, but the last."""
        for k in range(n + 1, self.n):
            hs.remove(self.spark, f"{self.path}/{k:04d}")

    def forget(self) -> None:
        hs.remove(self.spark, self.path)


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS
) -> DataFrame:
    """One row per document: id, class_id (the least id of its class), class_size in documents and kept (it is the class's first document)."""
    table = _Tables(docs.sparkSession)
    groups, ids = _solve(table, docs, id_col, text_col, similarity, bands)
    size = table(groups.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")))
    own = _Tables(docs.sparkSession)(groups.join(size, "label").select("h1", "h2", "class_id", "class_size"))
    table.forget()
    out = ids.join(own, ["h1", "h2"])
    kept = F.col("id").eqNullSafe(F.col("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", kept.alias("kept"))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS
) -> DataFrame:
    """The documents, all columns, with one row of each class: that of the least id."""
    spark = docs.sparkSession
    table = _Tables(spark)
    groups, ids = _solve(table, docs, id_col, text_col, similarity, bands)
    # Of equal ids the one with the least hash; so one (id, text) is chosen for each class.
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "h1", "h2")).alias("x")).select("x.*")
    chosen = table(first.select("h1", F.col("h2").alias("check"), F.xxhash64("first").alias("id")))
    path = hs.shared_dir(spark, "kept")
    bits = hs.write(chosen, path)
    again = ids.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    table.forget()
    columns = docs.columns
    own = tc.free(columns, "h1", "h2", "id_hash")
    marked = docs.select("*", *(x.alias(n) for x, n in zip((*_halves(F.col(text_col)), F.xxhash64(id_col)), own, strict=True)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(path, bits, {"key": "u8", "check": "i8", "id": "i8"})
        for batch in batches:
            h1, h2, own_id = (batch.column(c).to_numpy() for c in own)
            known, first = store.values(h1.view(np.uint64), h2, "id")
            yield batch.filter(pa.array(known & (first == own_id)))

    out = marked.mapInArrow(of, marked.schema)
    if again:  # rows whose id and text are repeated
        out = out.dropDuplicates(own[:2])
    return out.select(*(f"`{c}`" for c in columns))


def _halves(text) -> tuple:
    """120 bits of the text's SHA-256 as two longs."""
    x = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    part = lambda a: F.conv(F.substring(x, a, 15), 16, 10).cast("long")
    # Stores are bucketed by the top bits of their key, so the first half is moved there.
    return F.shiftleft(part(1), 4), part(16)


def _solve(table: _Tables, docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (first, copies, h1, h2, label) and the rows' (id, h1, h2)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tc.text_column(batch, "text")
            for i, j in tc.slices(col, PART):
                words, bounds = _words(col.slice(i, j - i))
                each = [words[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                found = [sketch(w, bands).view(np.int64) if len(w) else None for w in each]
                bits = [parity(w) if len(w) else None for w in each]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, bits)]
                own = [batch.column(c).slice(i, j - i) for c in ("id", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([*own, *lists, pa.array(np.diff(bounds), pa.int32())], names)

    names = ["id", "h1", "h2", "buckets", "bits", "n"]
    h1, h2 = _halves(F.col(text_col))
    base = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    found = base.mapInArrow(sketched, f"{tc.kinds(base, ['id', 'h1', 'h2'])}, buckets array<long>, bits array<long>, n int")
    one = [F.first(c).alias(c) for c in ("buckets", "bits", "n")]
    texts = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), *one)
    # The lowest bits of a node's number are its class of length, so that pairs of unlike lengths go before anything is joined.
    length = F.least(F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(np.log(1.01 / similarity))), F.lit(63))
    nodes = table(texts.withColumn("node", F.monotonically_increasing_id() * 64 + length), wide=True)
    labels = _classes(table, docs, text_col, nodes, similarity)
    groups = nodes.select("node", "first", "copies", "h1", "h2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return table(groups.drop("node"), wide=True), base.select("id", "h1", "h2")


def _classes(table: _Tables, docs: DataFrame, text_col: str, nodes: DataFrame, similarity: float) -> DataFrame:
    """node and label (the least node of its class) of all nodes that share a bucket."""
    listed = nodes.select("node", F.explode("buckets").alias("bucket"))
    span = listed.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    full = table(span.where("leader < last").select("bucket", "leader"))
    members = table(listed.join(full, "bucket").select("bucket", "node", "leader"))
    labels = table(members.select("node").distinct().withColumn("label", F.col("node")))
    sketches = table(nodes.select("node", "n", *(F.col("bits")[k].alias(c) for k, c in enumerate(BITS))).join(labels.select("node"), "node", "left_semi"), wide=True)
    words = _candidate_words(table, docs, text_col, nodes.join(labels.select("node"), "node", "left_semi"))
    alike = F.abs(F.pmod("node", F.lit(64)) - F.pmod("leader", F.lit(64))) <= 1  # other lengths are not within the budget
    pairs = members.where(alike & F.expr("node > leader")).select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    known = table(_verified(_bounded(pairs, sketches, similarity), words, similarity))
    new = _components(table, known.where("near").select("u", "v"))  # as yet each node is its own label
    labels = table(labels.select("node").join(new, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    live = members.select("bucket", "node")
    for turn, parts in enumerate((*LEADERS, 0)):
        rows = live.join(labels, "node")
        mixed = table(rows.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket"))
        live = table(rows.join(mixed, "bucket").select("bucket", "node", "label"))
        if not live.limit(1).count():
            break
        if parts:
            pairs = _led(table, table(live.join(sketches, "node"), wide=True), similarity, turn, parts)
        else:
            pairs = _all_pairs(table, live, nodes, words, similarity)
        pairs = table(pairs.distinct().join(known, ["u", "v"], "left_anti"))
        if pairs.limit(1).count():
            found = table(_verified(pairs, words, similarity))
            labels, known = _joined(table, labels, found), known.unionByName(found)
        live = live.drop("label")
    return labels


def _renamed(rows: DataFrame, key: str, *more: str) -> DataFrame:
    return rows.select(key, *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "label", *more)))


def _led(table: _Tables, rows: DataFrame, similarity: float, turn: int, parts: int) -> DataFrame:
    """Pairs of each member and the leaders of the parts of its bucket, if they are of other classes and the bound allows a link."""
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(parts))
    leaders = table(rows.groupBy("bucket", part.alias("part")).agg(F.min("node").alias("node")).select("bucket", "node"))
    leading = table(_renamed(rows.join(leaders, ["bucket", "node"]), "bucket", *BITS), wide=True)
    return _pairs(rows.join(leading, "bucket").where((F.col("label") != F.col("x_label")) & _possible(similarity)))


def _pairs_of_words(blob: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """Labelled two-word shingles of a text (of one word: the word), and how many of them its prefix has."""
    words = blob.view(np.uint32).astype(np.uint64)
    return labelled(words, 2), int(np.floor(2 * (1 - similarity) * len(words) + 1 + 1e-9))


def _frequencies(each: DataFrame, words: _Shelf, path: str, similarity: float) -> int:
    """Write a store of how many of the texts (node, n) have each shingle, by the top 48 bits of its hash, for those in two or more; returns its bits.

    Shingles are summed in each task and sent as sorted, compressed runs.
    """
    bits = hs.bits_for(each.agg(F.sum("n")).first()[0] or 0, 1 << 19)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        edge = np.searchsorted(hs.bucket_of(key, bits), np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(edge))
        pack = zstandard.ZstdCompressor(level=1).compress
        data = []
        for b in full:
            own = slice(edge[b], edge[b + 1])
            parts = [np.diff(key[own] >> np.uint64(16), prepend=np.uint64(0)), count[own].astype(np.uint64)]
            data.append(pack(b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in parts)))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        read = words.reader()
        for batch in batches:
            for own in read(batch.column("node").to_numpy()):
                held.append(np.unique(_pairs_of_words(own, similarity)[0] & _TOP))
                n += len(held[-1])
                if n >= 1 << 19:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def write(table: pa.Table) -> pa.Table:
        bucket, keys, counts = table["bucket"][0].as_py(), [], []
        for data in table["data"].to_pylist():
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
            step, count = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
            keys.append(np.cumsum(step, dtype=np.uint64) << np.uint64(16))
            counts.append(count)
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        hs.put(f"{path}/{bucket:05d}.df", df[df > 1])
        hs.put(f"{path}/{bucket:05d}.key", key[df > 1])
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    runs = _dealt(each.select("node")).mapInArrow(counted, "bucket int, data binary")
    done = {r.bucket for r in runs.groupBy("bucket").applyInArrow(write, "bucket int").collect()}
    for b in set(range(1 << bits)) - done:
        for name in ("key", "df"):
            hs.put(f"{path}/{b:05d}.{name}", np.zeros(0, np.uint64))
    return bits


def _all_pairs(table: _Tables, live: DataFrame, nodes: DataFrame, words: _Shelf, similarity: float) -> DataFrame:
    """Pairs of different classes among all given members that can be links, by exact prefix filtering.

    With e edits between texts of M words at most, at least M - 1 - 2 e of their labelled two-word shingles are common, so within the budget at
    least (1 - 2 (1 - similarity)) n - 1 of those of a text of n words.  If each text puts its shingles in one common order, rarest first, the
    two share one of their first 2 (1 - similarity) n + 1.  Shingles that no other text has need no row, and those of a
    passage that many texts share come last, so texts do not meet by it.  Any fixed order is exact; this one makes the join small.
    """
    spark, begun = live.sparkSession, table.n
    each = table(live.select("node", "label").distinct().join(nodes.select("node", "n", "bits"), "node"), wide=True)
    path = hs.shared_dir(spark, "frequencies")
    bits = _frequencies(each, words, path, similarity)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, read = hs.Store(path, bits, {"key": "u8", "df": "i8"}), words.reader()
        for batch in batches:
            nodes, out, last = [], [], []
            for node, blob in zip(batch.column("node").to_pylist(), read(batch.column("node").to_numpy()), strict=True):
                own, n = _pairs_of_words(blob, similarity)
                own = np.sort(own)
                df = store.lookup(own & _TOP, "df")[1]
                first = np.lexsort((own, df))[:n]
                shared = own[first][df[first] > 1]
                nodes.append(np.full(len(shared), node, np.int64))
                out.append(shared.view(np.int64))
                last.append(np.concatenate([[0], out[-1][:-1]])[: len(shared)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, out, last)], ["node", "word", "last"])

    keyed = table(_dealt(each.select("node")).mapInArrow(prefixes, "node long, word long, last long").join(each.select("node", "label"), "node"))
    kinds = keyed.groupBy("word", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("word")
    kinds = table(kinds.agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    met = keyed.join(kinds, "word").withColumn("minor", F.col("label") != F.col("most")).drop("most", "label").join(each, "node")
    # Joined from the side of members outside the shingle's largest class; a pair of two such comes from its larger node.
    near = _renamed(met.where("minor"), "word", "last", "bits")
    once = ~F.col("minor") | (F.col("x_node") < F.col("node"))
    # Two texts with the same shingle before this one in their prefixes have met by that one.
    first = (F.col("last") != F.col("x_last")) | (F.col("last") == 0)
    apart = F.col("label") != F.col("x_label")
    pairs = table(_pairs(met.join(near, "word").where(once & first & apart & _possible_by_array(similarity))).distinct())
    hs.remove(spark, path)
    table.since(begun)
    return pairs


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.greatest("node", "x_node").alias("u"), F.least("node", "x_node").alias("v"))


def _bounded(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs that the bound allows."""
    x = sketches.withColumnRenamed("node", "u")
    y = sketches.select(F.col("node").alias("v"), *(F.col(c).alias(f"x_{c}") for c in ("n", *BITS)))
    return pairs.join(y, "v").join(x, "u").where(_possible(similarity)).select("u", "v")


def _joined(table: _Tables, labels: DataFrame, known: DataFrame) -> DataFrame:
    """The labels after the verified links are added."""
    ends = known.where("near").select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
    new = _components(table, ends.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    return table(moved.select("node", F.coalesce("least", "label").alias("label")))


class _Shelf:
    """A store of a few bytes or many for each node, in the shared folder."""

    SCHEMA = "bucket int, node long, blob binary"

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def rows(self, nodes: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
        """Rows for write()."""
        bucket = hs.bucket_of(tc.mix(nodes.view(np.uint64)), self.bits).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(nodes), pa.array(blobs, pa.binary())], ["bucket", "node", "blob"])

    def write(self, rows: DataFrame) -> _Shelf:
        """Write what rows() gave; of a node's rows, which are equal, one stays."""
        path = self.path

        def build(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            key, first = np.unique(tc.mix(table["node"].to_numpy().view(np.uint64)), return_index=True)
            blobs = [table["blob"][k].as_buffer() for k in first.tolist()]
            hs.put(f"{path}/{bucket:05d}.blob", *(bytes(b) for b in blobs))
            hs.put(f"{path}/{bucket:05d}.end", np.cumsum([b.size for b in blobs], dtype=np.int64))
            hs.put(f"{path}/{bucket:05d}.key", key)
            return pa.table({"bucket": pa.array([bucket], pa.int32())})

        rows.groupBy("bucket").applyInArrow(build, "bucket int").count()
        return self

    def reader(self):
        """A function of nodes, which must be in the store, in any order and repeated, that gives their bytes."""
        store = hs.Store(self.path, self.bits, {"key": "u8", "end": "i8", "blob": "u1"})

        def read(nodes: np.ndarray) -> list[np.ndarray]:
            keys, inverse = np.unique(tc.mix(nodes.view(np.uint64)), return_inverse=True)
            out = []
            for bucket, _, at, found in store.parts(keys):
                assert found.all()
                end, blob = store.column(bucket, "end"), store.column(bucket, "blob")
                out += [blob[end[k - 1] if k else 0 : end[k]] for k in at.tolist()]
            return [out[k] for k in inverse.tolist()]

        return read


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows over tasks for all cores: what is done for a row takes longer than its bytes tell."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _candidate_words(table: _Tables, docs: DataFrame, text_col: str, nodes: DataFrame) -> _Shelf:
    """A store of the words' hashes of the nodes of buckets; texts are read again instead of being shuffled with them."""
    spark = docs.sparkSession
    path = hs.shared_dir(spark, "candidates")
    bits = hs.write(nodes.select("h1", F.col("h2").alias("check"), "node"), path)
    shelf = _Shelf(f"{table.path}/words", hs.bits_for(4 * (nodes.agg(F.sum("n")).first()[0] or 0), SHELF))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(path, bits, {"key": "u8", "check": "i8", "node": "i8"})
        done: set[int] = set()
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            known, node = store.values(h1.view(np.uint64), h2, "node")
            own = []
            for k in np.flatnonzero(known).tolist():
                if node[k] not in done:  # a full memory only means that some are sent again
                    own.append(k)
                    if len(done) < 1 << 20:
                        done.add(int(node[k]))
            col = tc.text_column(batch, "text").take(pa.array(own, pa.int64()))
            for i, j in tc.slices(col, PART):
                words, bounds = _words(col.slice(i, j - i))
                words = (words >> np.uint64(32)).astype(np.uint32)
                yield shelf.rows(node[own[i:j]], [words[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])

    h1, h2 = _halves(F.col(text_col))
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    shelf.write(rows.mapInArrow(of, shelf.SCHEMA))
    hs.remove(spark, path)
    return shelf


def _verified(pairs: DataFrame, words: _Shelf, similarity: float) -> DataFrame:
    """u, v and near: is their edit distance within the budget?"""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = words.reader()
        for batch in batches:
            near = []
            for at in range(0, len(batch), ROWS):
                ends = [read(batch.column(c).slice(at, ROWS).to_numpy()) for c in ("u", "v")]
                for a, b in zip(*(([x.view(np.uint32) for x in end]) for end in ends), strict=True):
                    most = budget(len(a), len(b), similarity)
                    near.append(distance(a, b, most) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(near, pa.bool_())], ["u", "v", "near"])

    return _dealt(pairs.select("u", "v")).mapInArrow(of, "u long, v long, near boolean")


def _components(table: _Tables, edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of all linked nodes."""
    now = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        large = table(large.distinct())
        low = table(large.groupBy("u").agg(F.min("v").alias("least")))
        small = large.join(low, "u").select("v", "least").where("v <> least").union(low.select("u", "least")).toDF("u", "v")
        now = table(small.distinct())
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
