"""One pass over stored items, and where an item is found."""

import random

from conftest_llm import KINDS, prose

from shellspark.llm import decontaminate as dc
from shellspark.llm import hashstore as hs
from shellspark.llm import queries


def edited(words, seed, n):
    rng, out = random.Random(seed), list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [out[at], "more"]])
    return out


def test_one_pass_at_any_size_of_the_benchmark(spark, monkeypatch):
    """Thousands of items in many files and buckets: one Python node, no broadcast, and all planted items found."""
    queries.prepare(spark)
    monkeypatch.setattr(hs, "bits_for", lambda rows: 4)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(f"i{k}", prose(12 + k % 30, k, vocabulary)) for k in range(2000)]
    docs, expected = [], set()
    for k in range(60):
        item = items[k * 31][1].split(" ")
        body = [*prose(80, 9000 + k).split(" "), *edited(item, k, len(item) // 6), *prose(30, 9500 + k).split(" ")]
        docs.append((k, " ".join(body), None, None, 0))
        expected.add((k, items[k * 31][0]))
    own = spark.createDataFrame(docs, KINDS).repartition(4)
    out = dc.find(own, spark.createDataFrame(items, "item_id string, text string"), item_bytes=4000, keep=["doc_id", "text"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan
    got = {(r.doc_id, h.item_id): (h, r.text) for r in out.collect() for h in r.hits}
    assert expected <= set(got)
    texts = dict(items)
    for (_, item), (h, text) in got.items():
        words, want = dc.item_words(text).tolist(), dc.item_words(texts[item]).tolist()
        e = dc.pieces(len(want), dc.RATE)[0]
        assert dc.nearest(want, words, e) == (h.errors, h.end_word)  # the whole text: first end of a nearest run
        run = words[h.start_word : h.end_word]
        assert dc.nearest(want, run, e)[0] == h.errors  # no shorter run that ends there is as near
        assert not run or dc.nearest(want, run[1:], e)[0] > h.errors or len(run) <= len(want) - h.errors


def test_items_that_share_pieces_and_ids(spark):
    items = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "delta beta"), (None, "gamma"), (2, None), (3, "!!"), (4, "alpha beta zeta eta theta")]
    docs = [(0, "Alpha, beta: gamma delta beta", None, None, 0), (1, "gammas", None, None, 0), (2, None, None, None, 0), (3, "x alpha beta zeta iota theta", None, None, 0)]
    out = dc.find(spark.createDataFrame(docs, KINDS), spark.createDataFrame(items, "item_id long, text string"), keep=["doc_id"])
    got = {r.doc_id: sorted(((h.item_id or 0), h.errors, h.start_word, h.end_word) for h in r.hits) for r in out.collect()}
    assert got == {0: [(0, 0, 2, 3), (1, 0, 0, 3), (1, 0, 3, 5)], 1: [], 2: [], 3: [(4, 1, 1, 6)]}
