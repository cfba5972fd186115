"""Each operator against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_llm import KINDS, LONG, TEXTS, near, prose, rows
from shellspark.llm import decontaminate as dc
from shellspark.llm import kneser_ney as kn
from shellspark.llm import license_scan as ls
from shellspark.llm import line_quality as lq
from shellspark.llm import order_minhash as om
from shellspark.llm import pieces, queries, sharding
from shellspark.llm import textcore as tc


def by_row(out, *columns):
    return Counter(tuple(r[c] for c in columns) for r in out.collect())


def test_words_and_hashes():
    col = pa.array(["ab  cd\tab", None, "", " cd", "xyz"], pa.large_string())
    batch = pa.RecordBatch.from_arrays([col], ["t"])
    data, offsets = tc.raw(tc.text_column(batch, "t"))
    starts, ends, bounds = tc.spans(data, offsets, tc.NOT_WHITE)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["ab", "cd", "ab", "cd", "xyz"] and bounds.tolist() == [0, 3, 3, 3, 4, 5]
    h = tc.Hasher(1)(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert tc.inside_rows(bounds, 2).tolist() == [True, True, False, False]
    col = pa.array(["ab", "abc", "x" * 50], pa.large_string())
    assert list(tc.slices(col, 4)) == [(0, 1), (1, 2), (2, 3)]


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    expected = Counter()
    for doc, text, *_ in rows():
        ids = sp.encode(text or "", add_eos=True)
        expected[doc, len(ids) - 1, tuple(ids), sp.decode(ids)] += 1
    out = pieces.encode_decode(docs, queries.model_path()).collect()
    assert Counter((r.doc_id, len(r.ids) - 1, tuple(r.ids), r.decoded) for r in out) == expected
    counts = pieces.count(docs, queries.model_path())
    assert by_row(counts, "doc_id", "n_tokens") == Counter({k: n for k, n in _merge((x[:2], n) for x, n in expected.items()).items()})
    assert pieces.count(empty, queries.model_path()).count() == 0
    assert pieces.encode_decode(empty, queries.model_path()).count() == 0


def _merge(pairs):
    out = Counter()
    for k, n in pairs:
        out[k] += n
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("hot", [kn.HOT, 40])  # with 40, frequent words are cut into classes
def test_kneser_ney(spark, docs, empty, order, hot):
    train = docs.where("doc_id % 4 <> 0")
    model = kn.fit(train, order=order, bucket=5000, hot=hot)
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({65 + i: 97 + i for i in range(26)})) + [None]
    words, counts = Counter(), {k: Counter() for k in range(1, order + 1)}
    for doc, text, *_ in rows():
        if doc is not None and doc % 4:
            w = tokens(text)
            words.update(w)
            padded = ["<start>"] * (order - 1) + w
            counts[order].update(tuple(padded[i : i + order]) for i in range(len(w)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    n, v = sum(words.values()), len(words)
    d, total, left = {}, defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        by = Counter(c.values())
        d[k] = kn.discounts([by[i] for i in (1, 2, 3, 4)])
        for g, x in c.items():
            total[k, g[:-1]] += x
            left[k, g[:-1]] += d[k][min(x, 3)]

    def p(context, w):
        k = len(context) + 1
        c = counts[k][(*context, w)]
        own = max(c - d[k][min(c, 3)], 0)
        if k == 1:
            return own / total[1, ()] + left[1, ()] / total[1, ()] / (v + 1)
        low = p(context[1:], w)
        return own / total[k, context] + left[k, context] / total[k, context] * low if total[k, context] else low

    assert model.tokens == n and model.words == v and model.grams == {k: len(c) for k, c in counts.items()}
    for context in (("<start>",) * (order - 1), ("river",) * (order - 1), ("never seen",) * (order - 1)):
        assert sum(p(context, w) for w in [*words, "unknown"]) == pytest.approx(1)
    got = defaultdict(list)
    for r in kn.score(docs, model).collect():
        got[r.doc_id].append(r)
    for doc, text, *_ in rows():
        w = tokens(text)
        r = got[doc][0]
        assert (r.n_tokens, r.n_known) == (len(w), sum(words[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        padded = ["<start>"] * (order - 1) + w
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order - 1]), x)) for i, x in enumerate(w)))
    none = kn.fit(empty, order=order)
    assert {(r.base_score, r.score) for r in kn.score(docs, none).collect()} == {(0.0, 0.0)}
    assert kn.score(empty, model).count() == 0


def test_runs_and_hash_arrays():
    rng = np.random.default_rng(3)
    for words in (1, 2, 3, 4):
        columns = [rng.integers(0, 50, 3000).astype(np.uint32) * np.uint32(80_000_000) for _ in range(words)]
        columns, count = kn._summed(columns, rng.integers(1, 400, 3000))
        got, n = kn.decode(kn.encode(columns, count), len(count), words)
        assert all((a == b).all() for a, b in zip(got, columns, strict=True)) and (n == count).all()
    key = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    value = rng.integers(0, 600, len(key))
    arrays = kn._index(key, "k") | kn._small(value, "v")
    at, found = kn._find(arrays, "k", key)
    assert found.all() and (at == np.arange(len(key))).all() and (kn._value(arrays, "v", at) == value).all()
    assert not kn._find(arrays, "k", rng.integers(0, 1 << 63, 5000, dtype=np.uint64))[1].any()
    assert not kn._find(kn._index(key[:0], "k"), "k", key)[1].any()


def test_base_rules(docs, empty):
    out = {(r.doc_id, r.q.n_words): r.q for r in lq.judge(docs, into="q", keep=["doc_id"]).collect()}
    for doc, text, *_ in rows():
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(windows)
        again = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 8)}
        q = out[doc, len(w)]
        assert (q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again))
        assert q.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and q.kept == (not q.base_failed) and q.cleaned == t
    assert lq.judge(empty, into="q").count() == 0


def test_frequent_lines_are_counted_by_distinct_text_and_host(spark):
    unique = lambda k: prose(40, 1000 + k)
    texts = [(k, f"Common  LINE here\n{unique(k)}", "a") for k in range(8)]
    texts += [(20 + k, "Common line here\n" + "common line here\n" * 3 + prose(8, k) + "\n" + prose(5, 40 + k), "a") for k in range(2)]
    texts += [(40 + k, f"{prose(30, 7)}\nheld by copies only", "a") for k in range(9)]  # copies of one text
    texts += [(60 + k, f"common line here\n{unique(60 + k)}", "b") for k in range(3)]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in texts], KINDS)
    out = {r.doc_id: r.q for r in lq.judge(docs, into="q", most_docs=99, few_docs=5, share=0.5, most_removed=0.3).collect()}
    assert all(out[k].n_removed_lines == 1 and out[k].n_removed_words == 3 and out[k].kept and out[k].cleaned == unique(k) for k in range(8))
    assert all(out[20 + k].n_removed_lines == 4 and not out[20 + k].kept for k in range(2))
    assert all(out[40 + k].n_removed_lines == 0 and out[40 + k].kept for k in range(9))
    assert all(out[60 + k].n_removed_lines == 0 for k in range(3))
    by_id = {r.doc_id: r.q for r in lq.judge(docs, into="q", most_docs=8, few_docs=8, count_by="doc_id").collect()}
    assert all(by_id[40 + k].n_removed_lines == 2 and not by_id[40 + k].kept for k in range(9))  # nine documents, if ids count


def test_licenses(spark, docs, empty):
    apache = ls.TEMPLATES["Apache-2.0-header"]
    texts = [prose(300, 5) + "\nReleased under the MIT License.\n" + prose(300, 6), apache, prose(40, 7) + " " + near(apache, 3, 0.02) + prose(100, 8), "Released under another license.", LONG + " licensed UNDER cc by-nc 4.0", "MIT", None, ""]
    own = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], KINDS).repartition(2)
    found = {(r.doc_id, r.license) for r in ls.scan(own).collect()}
    assert {(0, "MIT-notice"), (1, "Apache-2.0-header"), (2, "Apache-2.0-header"), (4, "CC-BY-NC-4.0-notice")} <= found
    assert not {d for d, _ in found} & {3, 5, 6, 7}
    for doc, text in enumerate(texts):  # brute force: containment over the whole text
        g, _ = ls._shingles(*tc.raw(pa.array([text or ""], pa.large_string())))
        t = ls._Templates(ls.TEMPLATES)
        for name, own_set in zip(t.names, t.sets, strict=True):
            if (doc, name) in found:
                assert np.isin(own_set, g).mean() >= 0.8
    assert ls.scan(docs).count() == 0 and ls.scan(empty).count() == 0
    assert ls.scan(own, {"x": "MIT"}).collect()[0].doc_id == 5


def test_decontamination(spark, docs, empty):
    items = [(k, prose(20 + k, 500 + k)) for k in range(12)] + [(12, None), (13, "..."), (14, "short item"), (15, prose(20, 500))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    words = [t.split(" ") for _, t in items[:12]]
    texts = [prose(200, 9) + " " + items[0][1].upper() + " " + prose(50, 10), " ".join(words[1][:5] + ["odd"] + words[1][6:]), " ".join(words[2][:3] + words[2][5:]) + " " + prose(30, 11), " ".join(words[3][:10]), prose(100, 12), None, "", "this short item!", LONG + " " + items[4][1]]
    own = spark.createDataFrame([(k, t, "en", None, 1) for k, t in enumerate(texts)], KINDS)
    for size in (dc.ITEM_BYTES, 700):  # in one file, and in several
        out = dc.find(own, table, into="lang", item_bytes=size)
        assert out.columns == ["doc_id", "text", "source", "n_chars", "lang"]
        got = {(r.doc_id, h.item_id): h.errors for r in out.collect() for h in r.lang}
        expected = {}
        for doc, text in enumerate(texts):
            w = dc.item_words(text).tolist()
            for item, t in items:
                x = dc.item_words(t).tolist()
                e, _ = dc.pieces(len(x), dc.RATE)
                if x and (d := dc.nearest(x, w, e)[0]) <= e:
                    expected[doc, item] = d
        assert got == expected and {(0, 0), (0, 15), (1, 1), (2, 2), (7, 14), (8, 4)} <= got.keys() and (3, 3) not in got
    assert dc.find(docs, table).where(F.size("hits") > 0).count() == 0 and dc.find(empty, table).count() == 0
    assert dc.find(own, table.limit(0)).count() == len(texts)


def test_myers_distance():
    def slow(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            old, row = row, [0]
            for k, x in enumerate(item, 1):
                row.append(min(old[k - 1] + (x != w), old[k] + 1, row[-1] + 1))
            best = min(best, row[-1])
        return best

    rng = np.random.default_rng(0)
    for _ in range(500):
        a, b = (rng.integers(0, 3, n).tolist() for n in rng.integers(1, 12, 2))
        d = slow(a, b)
        for most in (0, 1, 3, 12):
            assert dc.nearest(a, b, most)[0] == min(d, most + 1)


def test_banded_alignment():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(1500):
        a, b = (rng.integers(0, 4, n) for n in rng.integers(0, 14, 2))
        d = slow(a.tolist(), b.tolist())
        for most in (0, 1, 2, 4, 9, 20):
            assert om.banded(a.tolist(), b.tolist(), most) == om.distance(a.astype(np.uint32), b.astype(np.uint32), most) == min(d, most + 1)


def test_near_duplicates(spark, docs, empty):
    base = [prose(150, 700 + k) for k in range(5)]
    texts = [*base, *(near(base[0], k, 0.02) for k in range(30)), base[1], base[1], " ".join(base[2].split(" ")[75:] + base[2].split(" ")[:75]), prose(4, 1), prose(4, 1).upper() + " !", prose(4, 2), None, "", None]
    own = spark.createDataFrame([(k, t, "en", None, 1) for k, t in enumerate(texts)], KINDS).repartition(4)
    words = []
    for t in texts:
        w, _ = om._words(pa.array([t or ""], pa.large_string()))
        words.append(w.tolist())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            most = om.budget(len(a), len(b), 0.8)
            if (texts[i] or "") == (texts[j] or "") or (a and b and om.banded(a, b, most) <= most):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = {r.doc_id: r for r in om.classes(own).collect()}
    assert {k: r.class_id for k, r in out.items()} == dict(enumerate(label))
    assert out[0].class_size == 31 and sum(r.kept for r in out.values()) == len(set(label))
    kept = om.representatives(own)
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == set(label)
    twice = om.representatives(docs)
    assert twice.where("doc_id = 7").count() == 1 and twice.where("doc_id is null").count() == 1 and twice.where("doc_id in (9, 10, 11)").count() == 1
    assert om.classes(docs).count() == len(rows()) and om.classes(empty).count() == 0 and om.representatives(empty).count() == 0


def test_order_matters_to_a_sketch():
    h = np.arange(1, 400, dtype=np.uint64)
    a, b = om.sketch(tc.mix(h)), om.sketch(tc.mix(h[::-1].copy()))
    assert (a == om.sketch(tc.mix(h.copy()))).all() and not (a == b).any()
    assert len(set(om.labelled(np.array([5] * 9, np.uint64)).tolist())) == 5  # equal shingles differ by occurrence


def test_sharding(docs, empty):
    out = sharding.shuffle(docs.withColumn("slot", F.lit("clash")), 5, 1, bucket_bytes=2000).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(rows()) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r.doc_id, r.text) for r in out) == Counter(r[:2] for r in rows())
    place = lambda x: {(r.doc_id, r.text, r.shard, r.slot) for r in x}
    again = sharding.shuffle(docs, 5, 1, bucket_bytes=2000).collect()
    assert place(again) == place(out) != place(sharding.shuffle(docs, 5, 2, bucket_bytes=2000).collect())
    assert sharding.shuffle(empty, 5, 1).count() == 0


def test_queries_have_the_contract_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(30, 3))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    q = queries.queries()
    d = str(tmp_path)
    out = q["op3_two_pass_shuffle"](spark, d)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = {k: t or "" for k, t in enumerate(TEXTS)}
    for r in out.where("doc_id is not null").collect():
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    out = q["op9_sentencepiece"](spark, d).where("doc_id = 4").first()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    ids = sp.encode("one", add_eos=True)
    assert (out.n_tokens, out.ids_sha256, out.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"one").hexdigest())
    for r in q["op1_kneser_ney"](spark, d).collect():
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
