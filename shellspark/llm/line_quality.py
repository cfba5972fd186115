"""Quality rules: lines that too many documents of a host share, and documents that little is left of.

A line is compared as its lower-cased words, by a 64-bit hash.  For each host the distinct documents with a line are counted.  Documents
are told apart by their text, so a document that is copied does not turn its own lines into boilerplate, or by an id column
(``count_by``).  A line of a host of h documents is above the limit if more than ``most_docs`` documents have it, or more than
``few_docs`` and more than ``share`` of the h: the first holds for every size, and the second lets a small host's boilerplate be found.
Lines above the limit are removed; a document that thereby loses more than ``most_removed`` of its words is depleted and rejected.

Plan: distinct (host, line, text) hashes are counted with partial aggregation in two steps, so neither a hot host nor a
hot line meets in one task; only lines above ``few_docs`` are joined to their host's size; the lines above the limit
become a sorted hash store that workers map, so documents are not shuffled.

Cases: null text is empty and has no words, and is rejected by the base rules; null hosts are one host; lines without words are
ignored and kept; an empty table gives an empty table; repeated rows are judged alike.  The verdicts come as one struct column
whose name is a parameter; a column of that name in the input, in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

MOST_DOCS, FEW_DOCS, SHARE, MOST_REMOVED = 10, 5, 0.1, 0.5
#: Base rules.
MIN_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words")
KIND = ", ".join(f"{m}: bigint" for m in MEASURES) + ", base_failed: boolean, kept: boolean, cleaned: string"
_NOT_BREAK = np.ones(256, dtype=bool)
_NOT_BREAK[10] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point of a word.
_WORD_CHAR = tc.NOT_WHITE.copy()
_WORD_CHAR[128:192] = False
_H: list[tc.Hasher] = []


def _hasher() -> tc.Hasher:
    if not _H:
        _H.append(tc.Hasher(5))
    return _H[0]


def _row_key(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return tc.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lines(data: np.ndarray, offsets: np.ndarray, words: tuple):
    """Lines with a word: starts, ends, first and last word, row and hash of lower-cased words."""
    starts, ends, bounds = words
    a, b, lines = tc.spans(data, offsets, _NOT_BREAK)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    full = last > first
    a, b, row, first, last = a[full], b[full], row[full], first[full], last[full]
    word = _hasher()(tc.LOWER[data], starts, ends)
    return a, b, first, last, row, _hasher().runs(word, first, last)


def _hash(batch: pa.RecordBatch, column: str) -> np.ndarray:
    data, offsets = tc.raw(tc.text_column(batch, column))
    return _hasher()(data, offsets[:-1], offsets[1:])


def _above(n: str, host_docs, most_docs: int, few_docs: int, share: float):
    return (F.col(n) > most_docs) | ((F.col(n) > few_docs) & (F.col(n) > share * host_docs))


def frequent_lines(
    docs: DataFrame, text_col: str, host_col: str, most_docs: int = MOST_DOCS, few_docs: int = FEW_DOCS, share: float = SHARE, count_by: str | None = None
) -> DataFrame:
    """host (hash), line (hash), n_docs and host_docs of each line above the limit."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, hosts, docs = tc.text_column(batch, "text"), _hash(batch, "host"), _hash(batch, "doc")
            for i, j in tc.slices(col):
                data, offsets = tc.raw(col.slice(i, j - i))
                text = docs[i:j] if count_by else _hasher()(data, offsets[:-1], offsets[1:])
                *_, row, h = _lines(data, offsets, tc.spans(data, offsets, tc.NOT_WHITE))
                _, own = np.unique(_row_key(h, row), return_index=True)
                row, h = row[own], h[own]
                # One row more for each document: line 0 stands for the host as a whole.
                host = np.concatenate([hosts[i:j][row], hosts[i:j]])
                line, doc = np.concatenate([h, np.zeros(j - i, np.uint64)]), np.concatenate([text[row], text])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (host, line, doc)], ["host", "line", "doc"])

    doc = F.col(count_by).cast("string") if count_by else F.lit("")
    texts = docs.select(F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), doc.alias("doc"))
    found = texts.mapInArrow(lines, "host long, line long, doc long")
    counts = found.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.where((F.col("n_docs") > min(few_docs, most_docs)) | (F.col("line") == 0))
    # The hosts' own rows and the candidates come from one aggregation; a window by host would gather a hot host's lines.
    path = hs.shared_dir(docs.sparkSession, "lines")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    hosts = counts.where("line = 0").select("host", F.col("n_docs").alias("host_docs"))
    return counts.where("line <> 0").join(hosts, "host").where(_above("n_docs", F.col("host_docs"), most_docs, few_docs, share))


def judge(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    into: str = "quality",
    keep: list[str] | None = None,
    most_docs: int = MOST_DOCS,
    few_docs: int = FEW_DOCS,
    share: float = SHARE,
    most_removed: float = MOST_REMOVED,
    count_by: str | None = None,
) -> DataFrame:
    """Columns ``keep`` (all, if not given) and a struct ``into`` with the measures, verdict and cleaned text."""
    keep = tc.others(docs.columns if keep is None else keep, into)
    lines = frequent_lines(docs, text_col, host_col, most_docs, few_docs, share, count_by)
    path = hs.shared_dir(docs.sparkSession, "frequent")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, line = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("host", "line"))
            yield pa.RecordBatch.from_arrays([pa.array(line_key(host, line).view(np.int64))], ["key"])

    bits = hs.write(lines.select("host", "line").mapInArrow(keys, "key long"), path)
    return _judged(docs, text_col, host_col, into, keep, path, bits, most_removed)


def _judged(docs, text_col, host_col, into, keep, path, bits, most_removed) -> DataFrame:
    own_text, own_host = tc.free([*keep, into], "text_", "host_")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hs.Store(path, bits, {"key": "u8"})
        for batch in batches:
            col, hosts = tc.text_column(batch, own_text), _hash(batch, own_host)
            for i, j in tc.slices(col):
                data, offsets = tc.raw(col.slice(i, j - i))
                n = j - i
                starts, ends, bounds = words = tc.spans(data, offsets, tc.NOT_WHITE)
                n_words = np.diff(bounds)
                a, b, first, last, row, h = _lines(data, offsets, words)
                raw_line = _row_key(_hasher()(data, a, b), row)
                _, own = np.unique(raw_line, return_index=True)
                dup = np.bincount(row, minlength=n) - np.bincount(row[own], minlength=n)
                word_chars = tc.totals(_WORD_CHAR[data].astype(np.int64), offsets)
                symbols = tc.totals(_SYMBOL[data].astype(np.int64), offsets)
                repeat = _repeated(_hasher()(data, starts, ends), bounds)
                out = frequent.has(line_key(hosts[i:j][row], h)) if len(h) else np.zeros(0, bool)
                removed_lines = np.bincount(row, out, n).astype(np.int64)
                removed = np.bincount(row, out * (last - first), n).astype(np.int64)
                failed = (n_words < MIN_WORDS) | (100 * repeat > MOST_REPEATED_PERCENT * n_words)
                kept = ~failed & (removed <= most_removed * n_words)
                numbers = dict(zip(MEASURES, (n_words, word_chars, symbols, dup, repeat, removed_lines, removed), strict=True))
                fields = [pa.array(numbers[m].astype(np.int64)) for m in MEASURES] + [pa.array(failed), pa.array(kept), _without(data, offsets, a[out], b[out])]
                struct = pa.StructArray.from_arrays(fields, [*MEASURES, "base_failed", "kept", "cleaned"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in keep), struct], [*keep, into])

    kinds = ", ".join(x for x in (tc.kinds(docs, keep), f"`{into}` struct<{KIND}>") if x)
    return docs.select(*keep, F.col(text_col).alias(own_text), F.col(host_col).cast("string").alias(own_host)).mapInArrow(of, kinds)


def line_key(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One key for a host and a line."""
    return tc.mix(host * np.uint64(0xD6E8FEB86659FD93) + line)


def _repeated(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each row in windows that the row has twice or more."""
    w, n = REPEAT_WINDOW, len(bounds) - 1
    inside = np.flatnonzero(tc.inside_rows(bounds, w))
    row = np.repeat(np.arange(n), np.diff(bounds))
    if not len(inside):
        return np.zeros(n, np.int64)
    key = _row_key(tc.ngrams(h, w)[inside], row[inside])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, inside[twice], 1)
    np.add.at(edge, inside[twice] + w, -1)
    return tc.totals((np.cumsum(edge[:-1]) > 0).astype(np.int64), bounds)


def _without(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The texts without the lines [a, b) and the line break behind each."""
    edge = np.zeros(len(data) + 1, np.int64)
    if len(a):
        stop = offsets[np.searchsorted(offsets, a, "right")]
        np.add.at(edge, a, 1)
        np.add.at(edge, np.minimum(b + 1, stop), -1)
    left = np.cumsum(edge[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(left)])[offsets].astype(np.int64)
    flat = data[left]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).cast(pa.string())
