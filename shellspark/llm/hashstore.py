"""Sorted hash arrays in the shared folder, memory-mapped by the workers.

A store is a folder with ``2**bits`` buckets.  Bucket b holds the keys whose top bits are b, sorted, and one
array per column in the same order.  Buckets are written by independent tasks under a temporary name and then
renamed, so a repeated or speculative task is harmless, and a lost executor loses nothing that is written.
A lookup sorts its keys once and searches each bucket's mapped array; nothing is loaded as a whole.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import SparkSession

from shellspark.plans.staging import shared_dir

__all__ = ["Sink", "Store", "arrays", "bits_for", "bucket_of", "few", "mapped", "put", "put_arrays", "remove", "shared_dir", "source", "write"]


def _fs(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def put(uri: str, *parts) -> None:
    """Write the buffers as one file, all or nothing."""
    fs, path = _fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own, compression=None) as f:
        for p in parts:
            f.write(p if isinstance(p, bytes) else np.ascontiguousarray(p).data.cast("B") if p.size else b"")
    _publish(fs, own, path)


def _publish(fs, own: str, path: str) -> None:
    """Give a whole file its name; where a repeated task finds the name taken (a rename onto a file fails on some file systems), the
    file that is there is whole and equal, and stays."""
    from pyarrow.fs import FileType

    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).type != FileType.File:
            raise
        fs.delete_file(own)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as an array; one that is not on a mounted file system is first copied beside the worker."""
    fs, path = _fs(uri)
    if urlparse(uri).scheme not in ("", "file"):
        local = os.path.join(tempfile.gettempdir(), f"store-{hashlib.sha256(uri.encode()).hexdigest()}")
        if not os.path.exists(local):
            own = f"{local}.{uuid.uuid4().hex}"
            atexit.register(_forget, local)
            with fs.open_input_stream(path, compression=None) as src, open(own, "wb") as dst:
                while block := src.read(1 << 22):
                    dst.write(block)
            os.replace(own, local)
        path = local
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


def _forget(local: str) -> None:
    """Delete a copy; workers that have mapped it keep what they see."""
    with contextlib.suppress(OSError):
        os.remove(local)


def put_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named arrays as one file that arrays() maps."""
    kinds = [(name, x.dtype.str, len(x)) for name, x in arrays.items()]
    head = json.dumps(kinds).encode()
    head = len(head).to_bytes(8, "little") + head
    parts = [head, bytes(-len(head) % 8)]
    for x in arrays.values():
        parts += [np.ascontiguousarray(x), bytes(-x.nbytes % 8)]
    put(uri, *parts)


def arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file of put_arrays(), memory-mapped."""
    raw = mapped(uri, "u1")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + size + -(8 + size) % 8, {}
    for name, kind, n in json.loads(raw[8 : 8 + size].tobytes()):
        width = np.dtype(kind).itemsize * n
        out[name] = raw[at : at + width].view(kind)
        at += width + -width % 8
    return out


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder that later steps no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df):
    """The rows in no more partitions than twice the cores: for each file of a local folder Spark starts some processes, where Hadoop's
    native library is missing, and each of them counts as a second executor until its program begins."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def bits_for(rows: int, per_bucket: int = 500_000) -> int:
    """Bucket bits so that a bucket has about ``per_bucket`` rows, whatever the number of rows."""
    return max(0, int(np.ceil(np.log2(max(1, rows / per_bucket)))))


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Store:
    """A reader; opens buckets when they are first needed."""

    def __init__(self, path: str, bits: int, dtypes: dict[str, str]):
        self.path, self.bits, self.dtypes, self.open = path, bits, dtypes, {}

    def column(self, bucket: int, name: str) -> np.ndarray:
        if (bucket, name) not in self.open:
            self.open[bucket, name] = mapped(f"{self.path}/{bucket:05d}.{name}", self.dtypes[name])
        return self.open[bucket, name]

    def parts(self, keys: np.ndarray):
        """For sorted keys: (bucket, slice of keys, positions in the bucket, found) for each bucket touched."""
        buckets = bucket_of(keys, self.bits)
        edges = np.flatnonzero(np.diff(buckets, prepend=-1)) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            bucket = int(buckets[a])
            own = self.column(bucket, "key")
            at = np.searchsorted(own, keys[a:b])
            at[at == len(own)] = 0
            yield bucket, slice(a, b), at, (own[at] == keys[a:b]) if len(own) else np.zeros(b - a, bool)

    def places(self, keys: np.ndarray, checks: np.ndarray):
        """As parts(), with rows found by key and ``check`` together; keys may occur more than once in a bucket."""
        for bucket, part, at, found in self.parts(keys):
            own, check, wanted = self.column(bucket, "key"), self.column(bucket, "check"), checks[part]
            here = np.flatnonzero(found)
            found[here] = check[at[here]] == wanted[here]
            rest = here[~found[here]]
            while len(rest):  # another row with this key may follow
                at[rest] += 1
                rest = rest[at[rest] < len(own)]
                rest = rest[own[at[rest]] == keys[part][rest]]
                hit = check[at[rest]] == wanted[rest]
                found[rest[hit]] = True
                rest = rest[~hit]
            yield bucket, part, at, found

    def values(self, keys: np.ndarray, checks: np.ndarray, *names: str) -> tuple:
        """Whether each (key, check) is known, in any order and repeated, and the columns' values (unknown: 0)."""
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        inverse = np.empty(len(k), np.int64)
        inverse[order] = np.cumsum(first) - 1
        k, c = k[first], c[first]
        known, out = np.zeros(len(k), bool), [np.zeros(len(k), self.dtypes[name]) for name in names]
        for bucket, part, at, found in self.places(k, c):
            known[part] = found
            for values, name in zip(out, names, strict=True):
                values[part][found] = self.column(bucket, name)[at[found]]
        return known[inverse], *(values[inverse] for values in out)

    def lookup(self, keys: np.ndarray, *names: str) -> tuple:
        """As values(), in a store whose keys are unique."""
        own, inverse = np.unique(keys, return_inverse=True)
        known, out = np.zeros(len(own), bool), [np.zeros(len(own), self.dtypes[name]) for name in names]
        for bucket, part, at, found in self.parts(own):
            known[part] = found
            for values, name in zip(out, names, strict=True):
                values[part][found] = self.column(bucket, name)[at[found]]
        return known[inverse], *(values[inverse] for values in out)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Membership of each key, in any order and repeated."""
        own, inverse = np.unique(keys, return_inverse=True)
        known = np.zeros(len(own), bool)
        for _, part, _, found in self.parts(own):
            known[part] = found
        return known[inverse]


def write(df, path: str) -> int:
    """Write a table of longs as a store with its columns, sorted by the first, which is the key; returns its bits.

    Rows with equal keys all stay, next to each other; a second column named ``check`` tells them apart.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    spark, (first, *names) = df.sparkSession, df.columns
    listed = f"{path}-rows"
    few(df.select(F.col(first).alias("key"), *names)).write.parquet(listed)
    rows = spark.read.parquet(listed)
    bits = bits_for(rows.count())

    def build(table: pa.Table) -> pa.Table:
        bucket, key = table["bucket"][0].as_py(), table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        for name in names:
            put(f"{path}/{bucket:05d}.{name}", table[name].to_numpy()[order])
        put(f"{path}/{bucket:05d}.key", key[order])
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    done = {r.bucket for r in rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(build, "bucket int").collect()}
    for b in set(range(1 << bits)) - done:
        for name in ("key", *names):
            put(f"{path}/{b:05d}.{name}", np.zeros(0, np.uint64))
    remove(spark, listed)
    return bits


class Sink:
    """A file of the shared folder that has its name only when it is whole."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = _fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.own, compression=None, buffer_size=1 << 20)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> str:
        self.stream.close()
        _publish(self.fs, self.own, self.path)
        return self.uri


def source(uri: str):
    """A stream over a file of the shared folder."""
    fs, path = _fs(uri)
    return fs.open_input_stream(path, compression=None)
