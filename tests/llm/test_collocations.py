"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import KINDS, LONG, TEXTS
from pyspark.sql import functions as F

from shellspark.llm import collocations as co
from shellspark.llm import queries
from shellspark.llm import textcore as tc

LOW = {65 + i: 97 + i for i in range(26)}


def brute(rows, least, top, percent=50):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        if len(words) == 2 and any(100 * b >= percent * a and words in (g[1:3], g[2:4]) for g, b in ((list(g), b) for g, b in f.items() if len(g) == 4 and g[0] == lang and b >= least)):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return Counter((lang, rank, g.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for rank, (s, a, g, x, y) in enumerate(sorted(own)[:top], 1))


def texts(seed):
    rng = random.Random(seed)
    words = "red green blue Éclair straße New york CITY of the".split()
    own = [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [(t, rng.choice(["en", "de", None])) for t in own + own[:9]] + [(t, "fr") for t in TEXTS if t != LONG]


@pytest.mark.parametrize(("least", "top", "part", "bucket"), [(3, 2000, co.PART, co.PER_BUCKET), (2, 7, 100, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, part, bucket):
    queries.prepare(spark)
    monkeypatch.setattr(co, "PER_BUCKET", bucket)
    rows = texts(least)
    docs = spark.createDataFrame([(k, t, lang, None, 0) for k, (t, lang) in enumerate(rows)], KINDS).repartition(3)
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("PIECE", "n", "key", "words", "rank")))
    assert Counter(map(tuple, co.mine(docs, least=least, top=top).collect())) == brute(rows, least, top)


def test_no_rows(spark, empty):
    assert co.mine(empty).collect() == []
    assert co.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_pieces_and_packing():
    col = pa.array(["", " One  two\tTHREE, four.five\n", ",,", "x"], pa.large_string())
    piece, row, words = co.piece_strings(*tc.raw(col))
    assert piece.to_pylist() == ["one two three", "four", "five", "x"] and row.tolist() == [1, 1, 1, 3] and words.tolist() == [3, 1, 1, 1]
    x = np.array([0, 5, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    assert np.array_equal(co._unplanes(co._planes(x)), x)


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_001
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(co._score(*map(F.col, "alr"))).first()
    assert row[0] == 1_000_000 * a * a // (left * right)
