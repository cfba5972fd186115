"""Ranked search against brute force."""

import re
from collections import Counter
from math import floor, log

import pytest
from conftest_llm import KINDS, TEXTS, prose
from pyspark.sql import functions as F

from shellspark.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {65 + i: 97 + i for i in range(26)}


def brute(docs, items, best):
    """docs: (doc_id, text) by row; items: (item_id, text).  Rows (item_id, rank, doc_id, score)."""
    terms = [Counter(TERM.findall((t or "").translate(LOW))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), own, size in zip(docs, terms, sizes, strict=True):
            score = 0
            for t in set(TERM.findall((text or "").translate(LOW))) & set(own):
                w = floor(1000 * log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * own[t]) // (1000 * own[t] + 8 * (10 + 90 * size * n // total)))
            if score:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1)]
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"best": 2, "seed_postings": 1, "per_bucket": 3}, {"best": 3, "seed_postings": 1000}])
def test_ranks_equal_brute_force(spark, limits):
    queries.prepare(spark)
    texts = [*TEXTS, *(prose(30 + k, 500 + k % 9) for k in range(60)), "Ünï ÄÖ äö", "river", "RIVER"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(7, TEXTS[7]), (None, prose(20, 3)), (None, "river stone")]
    items = [(1, prose(40, 501)), (2, None), (3, ""), (4, "river RIVER lamp1"), (5, "nowhere-to-be-found"), (6, "Ünï äÖ"), (7, TEXTS[12]), (None, "stone"), (8, prose(12, 4))]
    table = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], KINDS).repartition(3)
    got = lexical.rank(table, spark.createDataFrame(items, "item_id long, text string"), **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute(docs, items, limits.get("best", 10))


def test_no_rows_and_clashing_columns(spark, docs, empty):
    queries.prepare(spark)
    items = spark.createDataFrame([("a", "river stone")], "item_id string, text string")
    assert lexical.rank(empty, items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
    wide = docs.select("*", *(F.lit(1).alias(c) for c in ("Row", "TERM", "q", "score", "rank", "slice", "item_id")))
    wider = items.select("*", *(F.lit(1).alias(c) for c in ("Q", "key", "doc_id")))
    assert Counter(map(tuple, lexical.rank(wide, wider).collect())) == Counter(map(tuple, lexical.rank(docs, items).collect())) != Counter()
