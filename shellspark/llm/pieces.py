"""SentencePiece over a table of distinct marked words: token counts, encoding and decoding.

The library writes a text as marks and characters: a mark before the text and one for each space.  If no
piece of the model has a mark behind another character (checked), no merge can cross from a character to
a following mark, so a text's pieces are those of its marked words (a run of marks and what follows it up to
the next mark), one after another.  Each distinct marked word is segmented once by the library itself, the
results are kept as a sorted hash store in the shared folder, and documents look their words up in it by a
memory-mapped search: no document text is shuffled, only distinct words are.

Words are keyed by two independent 64-bit hashes.  A word that shares its first hash with another word of its slice is segmented
where it stands, by the library too.

Cases: null text is empty; an empty text has no tokens but the end id (if asked for); the mark character in a
text equals a space, as in the library; repeated rows give repeated rows; an empty table gives an empty table.
Only the id columns and the text are read; an id column that has a result's name, in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

MARK = "▁"
#: Distinct words that a task remembers so as to send each once; a full memory only means that some are sent again.
SEEN = 1 << 20
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[32] = False
DTYPES = {"key": "u8", "check": "u8", "n": "i4", "ids_at": "i8", "ids": "i4", "text_at": "i8", "text": "u1"}


@lru_cache(maxsize=2)
def library(model: str):
    """The library's processor; refuses a model whose pieces cross marks or that adds no mark before a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces) or sp.encode("a  b") == sp.encode("a b") or sp.decode(sp.encode(" a")) != " a":
        raise ValueError(f"{model}: pieces of this model may cross words")
    return sp


@lru_cache(maxsize=1)
def _hashers() -> tuple[tc.Hasher, tc.Hasher]:
    return tc.Hasher(41), tc.Hasher(42)


def _marked(col: pa.Array) -> pa.Array:
    """Texts with spaces for marks and the leading space that stands for the first mark."""
    col = pc.replace_substring(col, MARK, " ")
    return pc.if_else(pc.equal(pc.binary_length(col), 0), col, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string())))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked words that cover all bytes: starts, ends, first word of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _segment(words: list[str], sp) -> list[list[int]]:
    """Ids of words that each begin with a space."""
    ids = sp.encode([w[1:] for w in words])
    one = [sp.piece_to_id(MARK)]
    return [x if w != " " else one for w, x in zip(words, ids, strict=True)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, _ = _hashers()
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        col = _marked(tc.text_column(batch, "text"))
        for i, j in tc.slices(col):
            data, offsets = tc.raw(col.slice(i, j - i))
            starts, ends, _ = _words(data, offsets)
            h, at = np.unique(hasher(data, starts, ends), return_index=True)
            new = ~np.isin(h, seen, assume_unique=True) if len(seen) else np.ones(len(h), bool)
            seen = np.union1d(seen, h[new]) if len(seen) < SEEN else h
            s, e = starts[at[new]], ends[at[new]]
            flat = tc.gather(data, s, e - s)
            bounds = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])], ["word"])


class Pieces:
    """The table of distinct marked words of ``docs`` (all of them, over whole texts) for one model."""

    def __init__(self, docs: DataFrame, text_col: str, model: str, with_ids: bool):
        spark = docs.sparkSession
        library(model)
        self.model, self.with_ids, self.path = model, with_ids, hs.shared_dir(spark, "pieces")
        listed = f"{self.path}-words"
        docs.select(F.col(text_col).alias("text")).mapInArrow(_distinct, "word string").distinct().write.parquet(listed)
        words = spark.read.parquet(listed)
        n, size = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
        self.bits = bits = hs.bits_for(max(n, (size or 0) // 16))
        path = self.path

        def segment(batches):
            sp, (h1, h2) = library(model), _hashers()
            for batch in batches:
                col = tc.text_column(batch, "word")
                data, offsets = tc.raw(col)
                key = h1(data, offsets[:-1], offsets[1:])
                check = h2(data, offsets[:-1], offsets[1:])
                words = col.to_pylist()
                ids = _segment(words, sp)
                out = [pa.array(hs.bucket_of(key, bits), pa.int32()), pa.array(key.view(np.int64)), pa.array(check.view(np.int64))]
                if with_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array([" " + t for t in sp.decode(ids)])]
                else:
                    out += [pa.array(list(map(len, ids)), pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names)

        def build(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            key = table["key"].to_numpy().view(np.uint64)
            order = np.argsort(key, kind="stable")
            table = table.take(order)
            at = f"{path}/{table['bucket'][0].as_py():05d}"
            hs.put(f"{at}.check", table["check"].to_numpy())
            if with_ids:
                ids, text = table["ids"].combine_chunks(), table["text"].combine_chunks().cast(pa.large_string())
                flat, bounds = tc.raw(text)
                hs.put(f"{at}.ids_at", ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py())
                hs.put(f"{at}.ids", ids.flatten().to_numpy())
                hs.put(f"{at}.text_at", bounds)
                hs.put(f"{at}.text", flat)
            else:
                hs.put(f"{at}.n", table["n"].to_numpy())
            hs.put(f"{at}.key", key[order])
            return pa.table({"bucket": table["bucket"][:1].cast(pa.int32())})

        names = ["bucket", "key", "check", *(["ids", "text"] if with_ids else ["n"])]
        kinds = "bucket int, key long, check long, " + ("ids array<int>, text string" if with_ids else "n int")
        built = {r.bucket for r in words.mapInArrow(segment, kinds).groupBy("bucket").applyInArrow(build, "bucket int").collect()}
        for b in set(range(1 << bits)) - built:  # a bucket that got no word
            for name, kind in DTYPES.items():
                if (name == "n") != with_ids or name in ("key", "check"):
                    hs.put(f"{path}/{b:05d}.{name}", np.zeros(int(name.endswith("_at")), kind))
        hs.remove(spark, listed)

    def reader(self):
        """For use in a task: a function from a slice of texts to (words' counts, ids or texts) by position."""
        store, sp, (h1, h2), with_ids = hs.Store(self.path, self.bits, DTYPES), library(self.model), _hashers(), self.with_ids

        def read(col: pa.Array):
            data, offsets = tc.raw(col)
            starts, ends, bounds = _words(data, offsets)
            key, first, inverse = np.unique(h1(data, starts, ends), return_index=True, return_inverse=True)
            s, e = starts[first], ends[first]
            check = h2(data, s, e)
            n = np.zeros(len(key), np.int64)
            known = np.zeros(len(key), bool)
            ids, texts, which = [], [], []
            for bucket, part, at, found in store.places(key, check):
                at, own = at[found], np.arange(part.start, part.stop)[found]
                known[own] = True
                if with_ids:
                    for name, out in (("ids", ids), ("text", texts)):
                        edge = store.column(bucket, f"{name}_at")
                        size = edge[at + 1] - edge[at]
                        out.append((tc.gather(store.column(bucket, name), edge[at], size), size))
                    which.append(own)
                    n[own] = ids[-1][1]
                else:
                    n[own] = store.column(bucket, "n")[at]
            # Words with equal first hashes would have met in one entry of ``key``; they are told apart by the second.
            odd = ~known[inverse] | (h2(data, starts, ends) != check[inverse])
            return data, starts, ends, bounds, inverse, n, odd, (ids, texts, which), sp

        return read


def count(docs: DataFrame, model: str, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id columns and n_tokens: the number of the library's ids for each whole text, without begin or end."""
    pieces = Pieces(docs, text_col, model, with_ids=False)
    ids = tc.others(id_cols, "n_tokens")
    own = tc.free(ids, "text_")[0]

    def of(batches):
        read = pieces.reader()
        for batch in batches:
            col = _marked(tc.text_column(batch, own))
            for i, j in tc.slices(col):
                data, starts, ends, bounds, inverse, n, odd, _, sp = read(col.slice(i, j - i))
                # Frequencies of (document, word), joined to the counts by the word's place in the table.
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                pair, freq = np.unique((row * len(n) + inverse)[~odd], return_counts=True)
                total = np.bincount(pair // max(1, len(n)), freq * n[pair % max(1, len(n))], j - i).astype(np.int64)
                for k in np.flatnonzero(odd):
                    total[row[k]] += len(_segment([data[starts[k] : ends[k]].tobytes().decode()], sp)[0])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ids), pa.array(total, pa.int64())], [*ids, "n_tokens"])

    kinds = ", ".join(x for x in (tc.kinds(docs, ids), "n_tokens long") if x)
    return docs.select(*ids, F.col(text_col).alias(own)).mapInArrow(of, kinds)


def encode_decode(docs: DataFrame, model: str, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), add_end: bool = True) -> DataFrame:
    """id columns, ids array<int> (with the end id if asked for) and decoded string, for each whole text."""
    pieces = Pieces(docs, text_col, model, with_ids=True)
    keep = tc.others(id_cols, "ids", "decoded")
    own = tc.free(keep, "text_")[0]

    def of(batches):
        read = pieces.reader()
        for batch in batches:
            col = _marked(tc.text_column(batch, own))
            for i, j in tc.slices(col):
                data, starts, ends, bounds, inverse, n, odd, (ids, texts, which), sp = read(col.slice(i, j - i))
                fixed = {int(k): _segment([data[starts[k] : ends[k]].tobytes().decode()], sp)[0] for k in np.flatnonzero(odd)}
                spelt = {k: " " + sp.decode(x) for k, x in fixed.items()}
                tail = np.full(j - i, sp.eos_id(), np.int32) if add_end else None
                out_ids, size = _laid(ids, which, len(n), inverse, bounds, {k: np.array(x, np.int32) for k, x in fixed.items()}, np.int32, tail)
                out_text, width = _laid(texts, which, len(n), inverse, bounds, {k: np.frombuffer(x.encode(), np.uint8) for k, x in spelt.items()}, np.uint8, None)
                lists = pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.array(out_ids))
                text = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(width), pa.py_buffer(out_text)])
                text = pc.binary_replace_slice(text.cast(pa.large_binary()), 0, 1, b"").cast(pa.large_string())  # the first mark goes
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keep), lists, text.cast(pa.string())], [*keep, "ids", "decoded"])

    kinds = ", ".join(x for x in (tc.kinds(docs, keep), "ids array<int>, decoded string") if x)
    return docs.select(*keep, F.col(text_col).alias(own)).mapInArrow(of, kinds)


def _laid(found: list, which: list, n: int, inverse: np.ndarray, bounds: np.ndarray, extra: dict[int, np.ndarray], kind, tail) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of all rows by position, with the rows' offsets; extra: values of single positions; tail: one value behind each row."""
    pool = [np.asarray(v) for v, _ in found] + [np.asarray(x) for x in extra.values()] + ([tail] if tail is not None else [])
    sizes = [s for _, s in found] + [np.array([len(x)]) for x in extra.values()] + ([np.ones(len(tail), np.int64)] if tail is not None else [])
    values = np.concatenate(pool).astype(kind) if pool else np.zeros(0, kind)
    size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    entry = np.full(n, -1, np.int64)
    if which:
        entry[np.concatenate(which)] = np.arange(sum(map(len, which)))
    use = entry[inverse]
    base = sum(map(len, which))
    for k, position in enumerate(extra):
        use[position] = base + k
    edge = bounds.astype(np.int64)
    if tail is not None:
        use = np.insert(use, bounds[1:], base + len(extra) + np.arange(len(tail)))
        edge = edge + np.arange(len(edge))
    run = np.concatenate([[0], np.cumsum(size[use])]).astype(np.int64)
    return tc.gather(values, at[use], size[use]), run[edge]
