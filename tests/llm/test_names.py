"""Columns whose names an operator uses itself, in any case, are kept or replaced as its docstring says."""

import pytest
from conftest_llm import KINDS, prose
from pyspark.sql import functions as F

from shellspark.llm import decontaminate, license_scan, line_quality, order_minhash, pieces, queries, sharding, url_filter, warc
from shellspark.llm import kneser_ney as kn

EXTRA = (
    "SLOT Shard QUALITY Hits HOST Path RULE Verdict SCORE key KEY_ __key __text __host __size __row __bucket __hits __quality __url "
    "text_ HOST_ row_ size_ bucket_ hits_ url_ path_ rule_ verdict_ key1_ h1 h2 id_hash node label bucket n bits ids decoded n_tokens license"
).split()
REPLACED = {"shuffle": {"SLOT", "Shard"}, "quality": {"QUALITY"}, "hits": {"Hits"}, "urls": {"HOST", "Path", "RULE", "Verdict", "SCORE"}}


@pytest.fixture(scope="module")
def wide(spark):
    queries.prepare(spark)
    rows = [(k, prose(60, k), "en", "s", 1) for k in range(4)]
    docs = spark.createDataFrame(rows, KINDS).withColumn("url", F.lit("http://a.example.org/x"))
    return docs.select("*", *(F.concat(F.lit(f"{c}/"), F.col("doc_id")).alias(c) for c in EXTRA))


def check(out, replaced, more):
    rest = [c for c in EXTRA if c not in replaced]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "url", *rest, *more]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3]
    for r in got:
        assert all(r[c] == f"{c}/{r.doc_id}" for c in rest)


def test_operators_that_keep_all_columns(spark, wide):
    items = spark.createDataFrame([("one", prose(30, 99)), ("two", prose(60, 2))], "item_id string, text string")
    check(sharding.shuffle(wide, 2, 1), REPLACED["shuffle"], ["shard", "slot"])
    check(line_quality.judge(wide), REPLACED["quality"], ["quality"])
    found = decontaminate.find(wide, items)
    check(found, REPLACED["hits"], ["hits"])
    assert [(r.doc_id, h.item_id) for r in found.collect() for h in r.hits] == [(2, "two")]
    check(url_filter.judge(wide, queries.URL_RULES), REPLACED["urls"], ["host", "path", "rule", "verdict", "score"])
    check(order_minhash.representatives(wide), set(), [])


def test_operators_that_keep_id_columns(wide):
    model = queries.model_path()
    ids = ("doc_id", *EXTRA)
    assert pieces.count(wide, model, id_cols=ids).columns == ["doc_id", *(c for c in EXTRA if c != "n_tokens"), "n_tokens"]
    rest = [c for c in EXTRA if c not in ("ids", "decoded")]
    assert pieces.encode_decode(wide, model, id_cols=ids).columns == ["doc_id", *rest, "ids", "decoded"]
    assert pieces.encode_decode(wide, model, id_cols=ids).count() == pieces.count(wide, model, id_cols=ids).count() == 4
    out = license_scan.scan(wide, {"x": prose(60, 1)}, id_cols=ids, block=1)
    assert [r.doc_id for r in out.collect()] == [1] and "LICENSE" not in out.columns
    assert kn.score(wide, kn.fit(wide), id_cols=ids).count() == 4


def test_stages_of_the_pipeline(spark, wide, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, prose(30, 3000))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in cp.STAGES[:3]:
        check(stage(spark, wide, str(tmp_path)), set(), [])
    assert cp.STAGES[3][1](spark, wide, str(tmp_path)).count() == 4


def test_ids_that_are_not_integers_are_refused_by_archives(wide):
    with pytest.raises(TypeError):
        warc.write(wide, id_col="lang", payload_col="text")
