"""Ranked lexical search: the best documents for each query item, by integer BM25-like scores over postings bucketed by term.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.  A first pass over the documents
counts them, their terms and in how many documents each wanted term occurs.  A second writes the postings of the wanted terms (term,
document, impact) as a table bucketed by term; a term of many documents is cut into slices, so no bucket depends on one term.
The semi-join with the wanted terms comes before the shuffle: workers look terms up in a mapped hash store, nothing is broadcast.

Items are joined to their terms' postings; matches are scored in 64-bit integers, summed by item and document, and ranked by a window.  Common terms
would make a match of nearly each item and document, so the join is done in three steps that lose nothing:

1. the rarest terms of an item find some documents, which are scored in full; the k-th best of them is a score that the k-th place reaches at least;
2. the lightest terms that together stay below that score (at their highest impacts) cannot bring a document among the best by themselves: only the other terms
   find documents, and of these only those that could reach the score with all light terms stay;
3. for those, the light terms' postings are joined by term and document, the heaviest first, and documents that fall behind go at once.

Cases: null and empty texts have no terms and are no documents for the counts; items without terms, and terms that no document has, find nothing; each
row of either table counts by itself, repeated rows and ids too (equal rows get neighbouring ranks); equal scores go by doc_id, nulls last;
fewer than k documents with a score give fewer rows; an empty table gives an empty table; other columns are not read, whatever their names.
Terms are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashstore as hs
from . import textcore as tc

BEST = 10
#: Constants of the score: a match is SCALE * tf // (1000 * tf + 8 * m), with m = 10 + LENGTH * n * documents // all terms.
SCALE, LENGTH, FLOOR = 1_000_000_000, 90, 10
#: Postings of the rarest terms that the first step looks at, and documents that it scores in full, for each place that is asked for.
SEED_POSTINGS, FIRST = 50, 10
PER_BUCKET = 500_000
#: Light terms are joined in steps: first those that are needed to have this share of the score to be reached, then the next, the lightest last.
LEVELS = (1.0, 0.7, 0.4, 0.1)
_H: list[tc.Hasher] = []


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each term and the first term of each row."""
    if not _H:
        _H.extend(map(tc.Hasher, (21, 22)))
    starts, ends, bounds = tc.spans(data, offsets, tc.ALNUM)
    low = tc.LOWER[data]
    return _H[0](low, starts, ends), _H[1](low, starts, ends), bounds


def _asked(items: DataFrame) -> DataFrame:
    """A row for each item and term: q (the item's row), item_id, key and check (hashes)."""
    kind = items.schema["item_id"].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, check, bounds = _terms(*tc.raw(tc.text_column(batch, "text")))
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))
            _, at = np.unique(np.stack([row.astype(np.uint64), key, check]), axis=1, return_index=True)
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("q").take(own), batch.column("item_id").take(own).cast(to_arrow_type(kind)), pa.array(key[at].view(np.int64)), pa.array(check[at].view(np.int64))],
                ["q", "item_id", "key", "check"],
            )

    rows = items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id())
    return rows.mapInArrow(of, f"q long, item_id {kind.simpleString()}, key long, check long")


def _known(batch_col: pa.Array, store: hs.Store, *names: str) -> tuple:
    """Terms of each row in all; and for its wanted terms, once each: row, occurrences and the store's columns."""
    key, check, bounds = _terms(*tc.raw(batch_col))
    known, term, *rest = store.values(key, check, "term", *names)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[known]
    _, at, tf = np.unique(np.stack([row, term[known]]), axis=1, return_index=True, return_counts=True)
    return np.diff(bounds), row[at], tf, term[known][at], *(x[known][at] for x in rest)


def _statistics(docs: DataFrame, text_col: str, path: str, bits: int) -> DataFrame:
    """term and in how many documents it is; term -1: documents that have terms; -2: all terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(path, bits, {"key": "u8", "check": "u8", "term": "i8"})
        for batch in batches:
            col = tc.text_column(batch, text_col)
            for i, j in tc.slices(col):
                size, _, _, term = _known(col.slice(i, j - i), store)
                own, n = np.unique(term, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, [-1, -2]])), pa.array(np.concatenate([n, [(size > 0).sum(), size.sum()]]))], ["term", "n"])

    return docs.select(text_col).mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _postings(docs: DataFrame, id_col: str, text_col: str, path: str, bits: int, n_docs: int, n_terms: int) -> DataFrame:
    """term, slice, row (of the document), doc_id and impact."""
    kind = docs.schema[id_col].dataType
    names = ["term", "slices", "row", "doc_id", "impact"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = hs.Store(path, bits, {"key": "u8", "check": "u8", "term": "i8", "slices": "i8"})
        for batch in batches:
            ids, rows, col = batch.column(0), batch.column(2).to_numpy(), tc.text_column(batch, batch.schema.names[1])
            for i, j in tc.slices(col):
                size, row, tf, term, slices = _known(col.slice(i, j - i), store, "slices")
                m = np.array([FLOOR + LENGTH * int(n) * n_docs // max(n_terms, 1) for n in size], np.int64)
                impact = SCALE * tf // (1000 * tf + 8 * m[row])
                taken = ids.take(pa.array(i + row)).cast(to_arrow_type(kind))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term, slices, rows[i:j][row])] + [taken, pa.array(impact)], names)

    rows = docs.select(id_col, text_col, F.monotonically_increasing_id().alias(tc.free([id_col, text_col], "row")[0]))
    out = rows.mapInArrow(of, f"term long, slices long, row long, doc_id {kind.simpleString()}, impact long")
    return out.select("term", _slice().alias("slice"), "row", "doc_id", "impact")


def _slice() -> Column:
    """The slice of its term that a document's posting is in."""
    return F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", seed_postings: int = SEED_POSTINGS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``best`` documents with a score above 0.

    items: item_id and text.
    """
    spark = docs.sparkSession
    path = hs.shared_dir(spark, "search")
    _asked(items).write.parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")
    asked.select("key", "check").distinct().withColumn("term", F.monotonically_increasing_id()).write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    bits = hs.write(terms, f"{path}/wanted")
    _statistics(docs, text_col, f"{path}/wanted", bits).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    total = {r.term: r.df for r in counts.where("term < 0").collect()}
    n_docs, n_terms = total.get(-1, 0), total.get(-2, 0)
    n_postings = counts.where("term >= 0").agg(F.sum("df")).first()[0] or 0
    buckets = int(min(50_000, max(8, -(-n_postings // per_bucket))))
    share = max(1, n_postings // (4 * buckets))  # a quarter of a bucket at most comes from one slice
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = terms.join(counts, "term").withColumns({"slices": F.ceil(F.col("df") / share).cast("long"), "w": weight})
    weighted.write.parquet(f"{path}/weighted")
    weighted = spark.read.parquet(f"{path}/weighted")
    bits = hs.write(weighted.select("key", "check", "term", "slices"), f"{path}/sliced")
    name = f"postings_{uuid.uuid4().hex}"
    rows = _postings(docs, id_col, text_col, f"{path}/sliced", bits, n_docs, n_terms)
    rows.repartition(buckets, "term", "slice").write.bucketBy(buckets, "term", "slice").sortBy("term", "slice", "row").option("path", f"{path}/postings").saveAsTable(name)
    postings = spark.table(name)

    by_item = Window.partitionBy("q")
    before = lambda what, *order: F.coalesce(F.sum(what).over(by_item.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = asked.join(weighted.select("key", "check", "term", "df", "w", "slices"), ["key", "check"]).select("q", "item_id", "term", "df", "w", "slices")
    wanted = wanted.withColumn("seed", before("df", "df", "term") < best * seed_postings)
    each_slice = F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice")
    worth = F.sum(F.col("w") * F.col("impact")).alias("score")

    def matched(of: DataFrame) -> DataFrame:
        """q, row, doc_id and score by the terms of these rows."""
        own = of.select("q", "term", "w", each_slice)
        return postings.join(own, ["term", "slice"]).groupBy("q", "row").agg(F.first("doc_id").alias("doc_id"), worth)

    def completed(found: DataFrame, by: DataFrame) -> DataFrame:
        """q, row, doc_id and score of these rows (with the same columns) with what the terms ``by`` add to them."""
        own = found.select("q", "row").join(by.select("q", "term", "w", "slices"), "q").withColumn("slice", _slice())
        more = postings.join(own, ["term", "slice", "row"]).select("q", "row", "doc_id", (F.col("w") * F.col("impact")).alias("score"))
        return found.union(more).groupBy("q", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score"))

    def leading(scored: DataFrame, n: int) -> DataFrame:
        place = F.row_number().over(by_item.orderBy(F.desc("score"), "row"))
        return scored.withColumn("place", place).where(F.col("place") <= n).drop("place")

    kept = lambda part, df: df.write.parquet(f"{path}/{part}") or spark.read.parquet(f"{path}/{part}")
    first = kept("first", leading(matched(wanted.where("seed")), FIRST * best))
    reached = leading(completed(first, wanted.where("not seed")), best)
    reached = reached.groupBy("q").agg(F.min("score").alias("reached"), F.count(F.lit(1)).alias("n")).where(F.col("n") == best).drop("n")
    highest = postings.groupBy("term", "slice").agg(F.max("impact").alias("highest")).groupBy("term").agg(F.max("highest").alias("highest"))
    split = wanted.join(reached, "q", "left").join(highest, "term").withColumn("bound", F.col("w") * F.col("highest"))
    below, reach = before("bound", "w", "term") + F.col("bound"), F.coalesce("reached", F.lit(0))
    level = reduce(lambda rest, k: F.when(below < reach * LEVELS[k], F.lit(k + 1)).otherwise(rest), range(len(LEVELS)), F.lit(0))
    split = kept("split", split.withColumn("level", level))
    rest = [F.sum(F.when(F.col("level") > k, F.col("bound")).otherwise(0)).alias(f"rest{k}") for k in range(len(LEVELS) + 1)]
    limits = split.groupBy("q").agg(F.coalesce(F.max("reached"), F.lit(0)).alias("reached"), *rest)

    def able(scored: DataFrame, k: int) -> DataFrame:
        """The rows that can be among the best if all terms of higher levels come at their highest."""
        return scored.join(limits, "q").where(F.col("score") + F.col(f"rest{k}") >= F.col("reached")).select("q", "row", "doc_id", "score")

    scored = able(matched(split.where("level = 0")), 0)
    for k in range(1, len(LEVELS) + 1):
        scored = able(completed(kept(f"found{k}", scored), split.where(F.col("level") == k)), k)
    scored = scored.where("score > 0")
    order = by_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = asked.select("q", "item_id").distinct()
    top.join(names, "q").select("item_id", "rank", "doc_id", "score").write.parquet(f"{path}/top")
    spark.sql(f"drop table {name}")
    for part in ("wanted", "sliced", "postings", "first", *(f"found{k}" for k in range(1, len(LEVELS) + 1))):
        hs.remove(spark, f"{path}/{part}")
    return spark.read.parquet(f"{path}/top")
