"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into buckets of about ``BUCKET`` bytes by a seeded hash of the row's number in
its input; pass two puts each bucket in a fixed order, Fisher-Yates shuffles it with a generator seeded by seed and bucket, and
writes it.  The global order is that of the buckets; its n rows are cut into shards at n*s/shards, so shard sizes
differ by one row at most, and the slot is the place within the shard.

The input must give the same rows in the same partitions whenever it is read, as file scans do; the two passes check
each other, and a bucket whose size differs between them raises an error.  Equal rows and equal keys get numbers of their own, so no
group of them meets in one bucket.  Only the buckets' sizes come to the driver.

Cases: null text has no bytes; an empty table writes no rows; with fewer rows than shards some shards are empty; repeated rows are kept;
columns named shard or slot, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

BUCKET = 32 << 20
#: Partitions of the second pass; with more buckets than these a task takes several, one after another.
MOST_TASKS = 20_000
#: Bytes that a row counts besides its text.
ROW = 8


def row_size(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW).cast("long")


def shuffle(docs: DataFrame, shards: int, seed: int, text_col: str = "text", bucket_bytes: int = BUCKET) -> DataFrame:
    """Write the shards, partitioned by ``shard``, and read them back: the columns of ``docs``, shard int and slot long."""
    spark = docs.sparkSession
    keep = tc.others(docs.columns, "shard", "slot")
    own_row, own_size, own_bucket = tc.free([*keep, "shard", "slot"], "row_", "size_", "bucket_")
    rows = docs.select(*keep, F.monotonically_increasing_id().alias(own_row), row_size(F.col(text_col)).alias(own_size))
    total = rows.agg(F.sum(own_size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn(own_bucket, F.pmod(F.xxhash64(own_row, F.lit(seed)), F.lit(buckets)).cast("int")).drop(own_size)
    sizes = np.zeros(buckets, np.int64)
    for r in rows.groupBy(own_bucket).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r[0]] = r.n
    first, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    cuts = np.array([n * s // shards for s in range(shards + 1)])

    def fisher_yates(bucket: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The bucket's rows, which come in the order of their numbers, shuffled and placed."""
        table = pa.Table.from_batches(held).combine_chunks()
        if len(table) != sizes[bucket]:
            raise RuntimeError("the input has changed between the two passes; write it to a table first")
        order = np.random.Generator(np.random.PCG64([seed, bucket])).permutation(len(table))
        at = first[bucket] + np.arange(len(order))
        shard = np.searchsorted(cuts, at, "right") - 1
        columns = [table[c].combine_chunks().take(pa.array(order)) for c in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array(shard, pa.int32()), pa.array(at - cuts[shard], pa.int64())], [*keep, "shard", "slot"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            bucket = batch.column(own_bucket).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and bucket[a] != now:
                    yield fisher_yates(now, held)
                    held = []
                now = int(bucket[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield fisher_yates(now, held)

    tasks = min(buckets, MOST_TASKS)
    dealt = rows.repartitionById(tasks, F.pmod(own_bucket, F.lit(tasks))).sortWithinPartitions(own_bucket, own_row)
    moved = dealt.mapInArrow(each, ", ".join(x for x in (tc.kinds(docs, keep), "shard int, slot long") if x))
    path = hs.shared_dir(spark, "shards")
    moved.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(moved.schema).parquet(path).select(*moved.columns)
