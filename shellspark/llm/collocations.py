"""Phrase collocations by language: phrases of two and three words that occur more often than their parts let expect.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words at spaces and tabs.

1. Equal pieces of a language become one row with a multiplicity; all later passes read this table and weigh what they find.
2. Words, then pairs, then triples are counted.  A phrase that occurs ``least`` times has parts that do, so pairs are counted where both words,
   and triples where both pairs are frequent, which workers see in mapped hash stores.  Each task sums up what it has read and sends it,
   packed, to hash buckets; a bucket is counted by duckdb, out of core in the task's own temporary folder, and keeps what is frequent.
3. Words and pairs get dense numbers, so a pair is known by its words' numbers and a triple by its first pair's and its last word's.
   Counts of a candidate's parts are fetched by lookup requests that are shuffled to the parts; requests for one part are spread by salts.
4. Scores are integers of 38 digits.  Phrases are spelled out only for candidates that can be among the best of their language.

Cases: null and empty texts have no words; a null language is ``und``; equal texts count each time; ties go by count, then by the phrase's bytes;
languages with fewer candidates than asked for give fewer rows, without any none; an empty table gives an empty table; other columns are not
read, whatever their names; a word, piece or text may have any length.  Words are told apart, in a language, by 64 bits of hashes.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

LEAST, TOP, COVERED_PERCENT, SCALE = 10, 2000, 50, 1_000_000
NO_LANGUAGE = "und"
#: Entries of a bucket before they are summed up, bytes of pieces looked at together, memory of a bucket's database, and salts of a request.
PER_BUCKET, PART, MEMORY, SALTS = 4_000_000, 4 << 20, "256MB", 64
_H: list[tc.Hasher] = []

PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
WORD = ~PIECE_END
WORD[[0x20, 0x09]] = False
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x20] = False


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie end to end in ``data``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def piece_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces with their words put together by single spaces, the row of each, and its number of words."""
    starts, ends, bounds = tc.spans(data, offsets, WORD)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    breaks = np.cumsum(PIECE_END[data])[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
    last = np.concatenate([first[1:], [True]])
    lengths = ends - starts + ~last  # a space behind each word but a piece's last
    out = tc.gather(np.append(tc.LOWER[data], np.uint8(0x20)), starts, lengths)
    till = np.cumsum(lengths)
    out[till[~last] - 1] = 0x20
    return _strings(out, till[last]), row[first], np.diff(np.append(np.flatnonzero(first), len(starts)))


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece, words (in the piece) and n (how often it occurs)."""
    names = ["lang", "piece", "words", "n"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, langs = tc.text_column(batch, "text"), batch.column("lang").dictionary_encode()
            for i, j in tc.slices(col):
                piece, row, words = piece_strings(*tc.raw(col.slice(i, j - i)))
                coded = piece.dictionary_encode()
                lang = langs.indices.to_numpy()[i:j][row].astype(np.int64)
                _, at, n = np.unique(lang * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_index=True, return_counts=True)
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), piece.take(own).cast(pa.string()), pa.array(words[at]), pa.array(n)], names)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(of, "lang string, piece string, words long, n long")
    return rows.groupBy("lang", "piece").agg(F.first("words").alias("words"), F.sum("n").alias("n"))


def _together(batches: Iterator[pa.RecordBatch], limit: int = PART) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``limit`` bytes."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.nbytes for b in own) >= limit:
            yield pa.Table.from_batches(own).combine_chunks()
            own = []
    if own:
        yield pa.Table.from_batches(own).combine_chunks()


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its key (with the language), piece, and place in the data (start, end); and the data."""
    if not _H:
        _H.extend(map(tc.Hasher, (31, 32)))
    data, offsets = tc.raw(tc.text_column(table, "piece"))
    starts, ends, bounds = tc.spans(data, offsets, NOT_SPACE)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lang, at = tc.raw(tc.text_column(table, "lang"))
    return tc.mix(_H[0](data, starts, ends) + _H[1](lang, at[:-1], at[1:])[row]), row, starts, ends, data


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as their lowest bytes, then their next ones and so on: the zeros lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _packed(keys: np.ndarray, n: np.ndarray, buckets: int, lang: str = "") -> pa.RecordBatch:
    """Sums of equal keys, a row for each bucket: sorted keys as differences, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, n = keys[edge], np.add.reduceat(n, edge) if len(edge) else n
    bucket = (tc.mix(keys + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    rows = [(keys[part], n[part]) for part in np.split(order, at[1:])] if len(own) else []
    differences = [_planes(np.diff(k, prepend=np.uint64(0))) for k, _ in rows]
    columns = [pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(differences, pa.binary()), pa.array([_planes(x) for _, x in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "keys", "n"])


def _counted(rows: DataFrame, each: Callable, instances: int, least: int) -> DataFrame:
    """lang, key, n, part and at (a running number in the part) of what occurs ``least`` times.

    each: from a table of pieces, (lang, keys, weights) any number of times; instances: how many keys there are in all.
    """
    buckets = int(max(8, -(-instances // PER_BUCKET)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches):
            for lang, keys, n in each(table):
                yield _packed(keys, n, buckets, lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        folder = tempfile.mkdtemp(prefix="counts-")
        try:
            with duckdb.connect(config={"temp_directory": folder, "memory_limit": MEMORY, "threads": 1, "preserve_insertion_order": False}) as con:
                con.execute("create table t (lang varchar, key ubigint, n bigint)")
                for batch in batches:
                    for k in range(len(batch)):
                        lang, keys, n = (batch.column(c)[k].as_py() for c in ("lang", "keys", "n"))
                        own = pa.table({"key": np.cumsum(_unplanes(keys), dtype=np.uint64), "n": _unplanes(n).view(np.int64)})
                        con.register("own", own)
                        con.execute("insert into t select ?, key, n from own", [lang])
                        con.unregister("own")
                found = con.execute("select lang, key, sum(n)::bigint as n from t group by lang, key having sum(n) >= ?", [least])
                for got in found.to_arrow_reader(1 << 16):
                    k = len(got)
                    columns = [got.column(0), pa.array(got.column(1).to_numpy().view(np.int64)), got.column(2), pa.array(np.full(k, part, np.int32)), pa.array(np.arange(at, at + k))]
                    at += k
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "key", "n", "part", "at"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    sent = rows.mapInArrow(read, "lang string, bucket int, keys binary, n binary")
    return sent.repartition(buckets, "bucket").mapInArrow(count, "lang string, key long, n long, part int, at long")


def _numbered(spark: SparkSession, counted: DataFrame, path: str) -> tuple[DataFrame, int]:
    """lang, key, n and id, from 0 without gaps; and how many there are."""
    counted.write.parquet(f"{path}-parts")
    rows = spark.read.parquet(f"{path}-parts")
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one number for each task
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    shift = spark.createDataFrame(before or [(0, 0)], "part int, shift long")
    rows.join(F.broadcast(shift), "part").select("lang", "key", "n", (F.col("at") + F.col("shift")).alias("id")).write.parquet(path)
    hs.remove(spark, f"{path}-parts")
    return spark.read.parquet(path), total


def _answered(requests: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Requests with the columns that ``table`` has for their key, and no others' rows: the distinct requests go to the table, the
    answers back.  Requests for one key are spread over SALTS tasks."""
    salted = requests.withColumn("salt", F.pmod(F.xxhash64(*requests.columns), F.lit(SALTS)))
    answers = salted.select(key, "salt").distinct().join(table, key)
    return salted.join(answers, [key, "salt"]).drop("salt")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (those of its two parts at the lowest-scoring cut), n (words of the language) and score.

    A pair goes where a triple around it occurs at least ``covered_percent`` of a hundred times as often.
    """
    spark = docs.sparkSession
    path = hs.shared_dir(spark, "phrases")
    pieces(docs, text_col, lang_col).write.parquet(f"{path}/pieces")
    rows = spark.read.parquet(f"{path}/pieces")
    totals = rows.groupBy("lang").agg(F.sum(F.col("n") * F.col("words")).alias("words"), F.sum("words").alias("own")).collect()  # one row for each language
    instances = sum(r.own for r in totals)

    def of_words(table: pa.Table):
        key, row, *_ = _words(table)
        n, langs = table["n"].to_numpy(), table["lang"].combine_chunks().dictionary_encode()
        code = langs.indices.to_numpy()[row]
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            yield lang, key[own], n[row[own]]

    words, n_words = _numbered(spark, _counted(rows, of_words, instances, least), f"{path}/words")
    word_bits = max(1, int(n_words).bit_length())
    own_bits = hs.write(words.select("key", "id"), f"{path}/word-store")
    shift, mask = np.uint64(word_bits), (1 << word_bits) - 1

    def known_words(table: pa.Table):
        key, row, *_ = _words(table)
        known, word = hs.Store(f"{path}/word-store", own_bits, {"key": "u8", "id": "i8"}).lookup(key, "id")
        return known, word.view(np.uint64), row

    def known_pairs(known, word, row):
        """Whether a word and the next are frequent words of one piece, and their pair."""
        both = known[:-1] & known[1:] & (row[:-1] == row[1:])
        return both, (word[:-1] << shift) | word[1:]

    def of_pairs(table: pa.Table):
        known, word, row = known_words(table)
        both, pair = known_pairs(known, word, row)
        yield "", pair[both], table["n"].to_numpy()[row[:-1][both]]

    pairs, n_pairs = _numbered(spark, _counted(rows, of_pairs, instances, least), f"{path}/pairs")
    if int(n_pairs).bit_length() + word_bits > 63:
        raise ValueError(f"{n_words} frequent words and {n_pairs} frequent pairs do not fit into 63 bits")
    pair_bits = hs.write(_mixed(pairs.select("key", "id")), f"{path}/pair-store")

    def of_triples(table: pa.Table):
        known, word, row = known_words(table)
        both, pair = known_pairs(known, word, row)
        store = hs.Store(f"{path}/pair-store", pair_bits, {"key": "u8", "id": "i8"})
        frequent, number = store.lookup(tc.mix(pair[both]), "id")
        at = np.flatnonzero(both)[frequent]  # places of frequent pairs, and their numbers
        number = number[frequent].view(np.uint64)
        two = np.flatnonzero(np.diff(at) == 1)
        yield "", (number[two] << shift) | word[at[two] + 2], table["n"].to_numpy()[row[at[two]]]

    _counted(rows, of_triples, instances, least).select("key", "n").write.parquet(f"{path}/triples")
    triples = spark.read.parquet(f"{path}/triples")

    first, last = F.shiftright("key", word_bits), F.col("key").bitwiseAND(F.lit(mask))
    of = lambda name, f: words.select(F.col("id").alias(name), F.col("n").alias(f), *([F.col("lang")] if f == "f1" else []))
    two = pairs.select("id", "key", F.col("n").alias("a"), first.alias("w1"), last.alias("w2"))
    two = _answered(_answered(two, "w1", of("w1", "f1")), "w2", of("w2", "f2"))
    two.write.parquet(f"{path}/two")
    two = spark.read.parquet(f"{path}/two")
    three = triples.select(first.alias("b12"), F.col("n").alias("a"), last.alias("w3"))
    three = _answered(three, "b12", two.select(F.col("id").alias("b12"), F.col("a").alias("f12"), "lang", "w1", "w2", "f1"))
    three = three.withColumn("p23", F.shiftleft("w2", word_bits).bitwiseOR(F.col("w3")))
    three = _answered(three, "p23", two.select(F.col("key").alias("p23"), F.col("id").alias("b23"), F.col("a").alias("f23"), F.col("f2").alias("f3")))
    three.write.parquet(f"{path}/three")
    three = spark.read.parquet(f"{path}/three")

    around = reduce(DataFrame.union, (three.select(F.col(b).alias("id"), "a") for b in ("b12", "b23"))).groupBy("id").agg(F.max("a").alias("around"))
    free = two.join(around, "id", "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(covered_percent) * F.col("a")))
    none = F.lit(None).cast("long")
    free = free.select("lang", "w1", "w2", none.alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    cuts = [F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate((("f1", "f23"), ("f12", "f3")), 1)]
    longer = three.withColumn("cut", F.least(*cuts)).select("lang", "w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")
    free.union(longer).write.parquet(f"{path}/candidates")
    candidates = spark.read.parquet(f"{path}/candidates")

    by_lang = Window.partitionBy("lang")
    place = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a")))
    limit = candidates.select("lang", "score", "a").withColumn("place", place).where(F.col("place") <= top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    near = candidates.join(limit, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    near.write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    asked = near.select(F.explode(F.array("w1", "w2", "w3")).alias("id")).where("id is not null").distinct().join(words.select("id", "key"), "id")
    asked_bits = hs.write(asked.select("key", "id"), f"{path}/asked-store")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(f"{path}/asked-store", asked_bits, {"key": "u8", "id": "i8"})
        for table in _together(batches):
            key, _, starts, ends, data = _words(table)
            known, number = store.lookup(key, "id")
            own, at = np.unique(number[known], return_index=True)
            at = np.flatnonzero(known)[at]
            lengths = ends[at] - starts[at]
            yield pa.RecordBatch.from_arrays([pa.array(own), _strings(tc.gather(data, starts[at], lengths), np.cumsum(lengths)).cast(pa.string())], ["id", "word"])

    names = rows.mapInArrow(spelled, "id long, word string").groupBy("id").agg(F.min("word").alias("word"))
    names.write.parquet(f"{path}/names")
    names = spark.read.parquet(f"{path}/names")
    named = lambda w: names.select(F.col("id").alias(w), F.col("word").alias(f"{w}_word"))
    near = _answered(_answered(near, "w1", named("w1")), "w2", named("w2"))
    short = near.where("w3 is null").withColumn("w3_word", F.lit(None).cast("string"))
    near = short.unionByName(_answered(near.where("w3 is not null"), "w3", named("w3")))
    near = near.withColumn("phrase", F.concat_ws(" ", "w1_word", "w2_word", "w3_word"))
    near = near.withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    sizes = spark.createDataFrame([(r.lang, r.words) for r in totals], "lang string, n long")
    near.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score").write.parquet(f"{path}/best")
    for part in ("pieces", "word-store", "pair-store", "asked-store"):
        hs.remove(spark, f"{path}/{part}")
    return spark.read.parquet(f"{path}/best")


def _mixed(rows: DataFrame) -> DataFrame:
    """The first column's numbers spread over all 64 bits, as tc.mix() does."""
    columns = rows.columns
    name, *rest = columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = tc.mix(batch.column(name).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in rest)], columns)

    return rows.mapInArrow(of, tc.kinds(rows, columns))
