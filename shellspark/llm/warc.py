"""WARC archives: one gzip member per record, read back sequentially.

Writing.  A first pass takes each payload's hash; payloads that occur more than once keep their largest id in a sorted hash
store that workers map, so pages are never shuffled and a payload that a third of all pages share is no hot key.  Each task then
writes its rows to files of its own in the shared folder, under a temporary name until they are whole, so a
repeated task is harmless.

Reading.  A task reads a file from its start through an incremental zlib decoder; each gzip member is a record, its block is framed by
Content-Length, and block and payload digests are verified.  A file that is cut short, or a record that does not fit its
length or digest, raises an error.

Cases: null payload is empty; null url leaves the target out; of equal payloads of at least ``least_revisit`` bytes the rows with the
largest id are responses (rows of one id and payload are alike, so all of them are) and others revisit it; payloads
of rows that all lack an id are responses; an empty table gives no archive and no record; ids that are not integers are refused;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import hashstore as hs
from . import textcore as tc

FILE_BYTES = 1 << 30
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:x-page:"
RECORD = "record_id string, record_type string, target string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def digest(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _key(data) -> tuple[int, int]:
    h = hashlib.sha256(data).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:16], "little", signed=True)


def _payloads(batch: pa.RecordBatch) -> list[memoryview]:
    data, offsets = tc.raw(tc.text_column(batch, "__payload"))
    view = memoryview(np.ascontiguousarray(data))
    return [view[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


def record(kind: str, own: str, target: str | None, payload, payload_digest: str, refers_to: str | None) -> bytes:
    """A record's header and block: an HTTP response, without its body for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + bytes(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if target is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", target))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; one row per file: file, records, bytes."""
    spark = pages.sparkSession
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is not of an integer type")
    out, store = hs.shared_dir(spark, "warc"), hs.shared_dir(spark, "payloads")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_key(p) if len(p) >= least_revisit else (0, 0) for p in _payloads(batch)]
            long = [len(p) >= least_revisit for p in _payloads(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()), batch.column("__id")], ["key", "check", "id"]).filter(pa.array(long))

    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(payload_col).cast("string").alias("__payload"))
    found = rows.select("__id", "__payload").mapInArrow(keys, "key long, check long, id long")
    again = found.groupBy("key", "check").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").select("key", "check", "id")
    bits = hs.write(again, store)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = hs.Store(store, bits, {"key": "u8", "check": "i8", "id": "i8"})
        task, number, parts, size, count = TaskContext.get().partitionId(), 0, [], 0, 0
        done: list[tuple] = []
        sink = None
        for batch in batches:
            payloads = _payloads(batch)
            key = np.array([_key(p) for p in payloads], np.int64).reshape(-1, 2)
            known, first = kept.values(np.ascontiguousarray(key[:, 0]).view(np.uint64), key[:, 1], "id")
            ids, urls = batch.column("__id").to_pylist(), batch.column("__url").to_pylist()
            for k, p in enumerate(payloads):
                own, url = ids[k], urls[k]
                revisit = bool(known[k]) and len(p) >= least_revisit and own != first[k]
                raw = record("revisit" if revisit else "response", f"{_URN}{'' if own is None else own}", url, p, digest(p), f"{_URN}{first[k]}" if revisit else None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                if sink is None:
                    sink = hs.Sink(f"{out}/part-{task:06d}-{number:04d}.warc.gz")
                member = z.compress(raw) + z.flush()
                sink.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    done.append((sink.close(), count, size))
                    sink, number, size, count = None, number + 1, 0, 0
        if sink is not None:
            done.append((sink.close(), count, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    # The list of files is a table, so that reading starts when all are whole.
    listed = f"{out}-files"
    rows.mapInArrow(archive, "file string, records long, bytes long").write.parquet(listed)
    return spark.read.schema("file string, records long, bytes long").parquet(listed)


class Reader:
    """Records of one archive, in order."""

    def __init__(self, stream, chunk: int = 1 << 15):
        self.stream, self.chunk, self.rest = stream, chunk, b""

    def members(self) -> Iterator[bytes]:
        """Each gzip member, decoded as it is read."""
        while True:
            data = self.rest or self.stream.read(self.chunk)
            if not data:
                return
            z, out = zlib.decompressobj(31), []
            while True:
                out.append(z.decompress(data))
                if z.eof:
                    self.rest = z.unused_data
                    break
                data = self.stream.read(self.chunk)
                if not data:
                    raise ValueError("the archive ends within a record")
            yield b"".join(out)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Header fields (lower case) and block of each record."""
        for data in self.members():
            end = data.find(b"\r\n\r\n")
            lines = data[: max(end, 0)].decode().split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record in a member")
            fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            block, tail = data[end + 4 : end + 4 + int(fields["content-length"])], data[end + 4 + int(fields["content-length"]) :]
            if len(block) != int(fields["content-length"]) or tail != b"\r\n\r\n":
                raise ValueError("a record does not have its Content-Length")
            if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
                raise ValueError("a block does not have its digest")
            yield fields, block


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """record_id, type, target, payload length, digest, refers-to and payload of an HTTP record."""
    end = block.find(b"\r\n\r\n") + 4
    http, payload = block[:end].decode(), block[end:]
    declared = int(re.search(r"(?im)^content-length:\s*(\d+)", http)[1])
    own, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind != "revisit" and (declared != len(payload) or digest(payload) != own):
        raise ValueError("a payload does not have its length or digest")
    return fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), declared, own, fields.get("warc-refers-to", "").strip("<>") or None, payload


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives, with their payloads if wanted; a file is read by one task."""
    kinds = RECORD if payload else RECORD.removesuffix(", payload binary")
    names = [x.split()[0] for x in kinds.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with hs.source(file) as stream:
                    held, size = [], 0
                    for fields, block in Reader(stream).records():
                        held.append(parse(fields, block))
                        size += len(block) + 256
                        if size >= tc.SLICE:
                            yield _batch(held, names)
                            held, size = [], 0
                    if held:
                        yield _batch(held, names)

    n = max(1, files.count())  # one file to a task
    return files.select("file").repartitionByRange(n, "file").mapInArrow(of, kinds)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def page_id(record_id):
    """The page's id as a long column from its record's."""
    return F.expr(f"try_cast(nullif(substring({record_id}, {len(_URN) + 1}), '') as bigint)")
