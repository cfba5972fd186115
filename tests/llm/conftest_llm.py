import random

import pytest

WORDS = "river stone lamp winter paper garden copper signal thread harbor meadow engine silver cloud bridge forest candle mirror window basket".split()


def prose(n, seed, vocabulary=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n))


def near(text, seed, share=0.03):
    rng = random.Random(seed)
    return " ".join("changed" if rng.random() < share else w for w in text.split(" "))


LONG = prose(30000, 99)
TEXTS = [
    None,
    "",
    "   ",
    "\n\t",
    "one",
    "Ünïcode ▁ marks  and　wide spaces ✨ \x00 x",
    "a" * 3000 + " b",
    prose(60, 1),
    prose(60, 1),
    near(prose(200, 2), 1),
    prose(200, 2),
    near(prose(200, 2), 2),
    LONG,
    "word " * 50,
    "<s> </s> <unk> <0x0A> ▁▁\r\nline  two\n\nline  two\n",
]
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts=TEXTS):
    out = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[7], (None, "no id at all", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    from shellspark.llm import queries

    queries.prepare(spark)
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), KINDS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KINDS)
