"""Secret scans: patterns against brute force, the network against held-out findings and shapes."""

import random
import re

import numpy as np
import pytest
from conftest_llm import KINDS, TEXTS, prose
from pyspark.sql import functions as F

from shellspark.llm import queries
from shellspark.llm import secrets as se

PATTERNS = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, fits) in enumerate(PATTERNS) for m in p.finditer(text or "") if fits(m)]
    return [(se.KINDS[k], a, b) for a, k, b in sorted(found)]


def made(seed, n=150):
    """Texts of parts that make and break the patterns."""
    rng = random.Random(seed)
    parts = ["password", "Passwd", "SECRET", "tokeN", "api_key", "APIKEY", "ſecret", "toKen", "'", '"', " ", "  ", ":", "=", "abc", "abcdef", "Abc.12/x", "é", "AKIA", "AKIA1234", "ABCDEFGH12345678", "0123456789ab", "abcdef0123456789abcdef01", "z", "\n", "\x00", "—", "G"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return se.train(se.examples([prose(12, k) for k in range(50)]))


def test_patterns_equal_brute_force(spark):
    queries.prepare(spark)
    texts = [*TEXTS, *made(1), "é" * 50 + " token = abcdef" + prose(20000, 4) + " AKIA" + "Z" * 16]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)] + [(0, None, None, None, 0), (None, "token=abcdef", None, None, 0)], KINDS).repartition(3)
    none = spark.createDataFrame([], "before string, value string, after string, secret boolean")
    wide = docs.select("*", *(F.lit(1).alias(c) for c in ("SECRETS", "kind", "text_", "start", "spans_")))
    out = se.scan(wide, none)
    assert out.columns == [*docs.columns, "kind", "text_", "start", "spans_", "secrets"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2 and sum(len(r.secrets) for r in rows) > 100
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.secrets] == brute(r.text)


def test_base_spans_stay_beside_learned_ones(spark, tmp_path):
    value = "ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5"
    texts = [*made(2, 40), f"é export PAT={value} then", f"token = {value}", prose(300, 5), f"commit {'0123456789abcdef' * 2}", "see lamp.river.example.com/river/12 and lamp/river/stone12.html or 12e4567a-e89b-12d3-a456-426614174000", None, "", value]
    spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], KINDS).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op13_secret_scan(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        base = brute(t)
        spans = [tuple(s.split(":")) for s in out[k].spans.split(",") if s]
        assert [(a, int(b), int(c)) for a, b, c in spans if a != "learned"] == base
        assert (out[k].n_assign, out[k].n_access, out[k].n_hex) == tuple(sum(b[0] == kind for b in base) for kind in se.KINDS[:3])
        starts = [(int(b), se.KINDS.index(a)) for a, b, _ in spans]
        assert starts == sorted(starts)
    assert out[40].spans == f"learned:13:{13 + len(value)}" and out[41].spans == f"assign:0:{8 + len(value)}" and out[47].spans == f"learned:0:{len(value)}"
    assert "learned" not in out[42].spans + out[43].spans + out[44].spans


def test_the_network_on_held_out_findings(model):
    got = model.measured
    assert got["n"] == se.EXAMPLES // 4 and got["recall"] >= 0.95 and got["auc"] >= 0.93 and got["false_share"] <= 0.35
    assert abs(got["mean_p"] - got["share"]) < 0.05  # calibrated


def test_the_network_on_prefixes_that_it_has_not_seen():
    without = ("glpat-", "hf_", "npm_")
    own = se.train(se.examples([prose(12, k) for k in range(50)], without=without))
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"))
    texts = [f"see the notes {p}{''.join(rng.choice(letters, 28))} and so" for p in without for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = se.candidates(data, offsets, se.spans_of(data, offsets))
    assert len(found[0]) >= 175 and own.judge(data, offsets, *found)[0].mean() > 0.9


def test_context_decides_for_equal_values(model):
    rng = np.random.default_rng(2)
    texts = [f"the lamp {lead}{''.join(rng.choice(list('0123456789ABCDEF'), 40))} and" for _ in range(60) for lead in ("Authorization: Bearer ", "sha256:")]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows, starts, ends = se.candidates(data, offsets, se.spans_of(data, offsets))
    p = model.judge(data, offsets, rows, starts, ends)[1]
    assert len(rows) == 120 and se.auc(p, rows % 2 == 0) > 0.9


def test_gradients_equal_differences():
    ex = se.examples([prose(12, 1)], 24)
    parts = [s.encode() for f in ex for s in f[:3]]
    data, edges = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(s) for s in parts])
    x = se.Windows.cut(data, np.concatenate([[0], edges[2:-1:3]]), edges[0::3], edges[1::3], edges[2::3])
    y, net = np.array([f[3] for f in ex], float), se.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g = net.gradients(x, y)
    loss = lambda: np.mean(np.logaddexp(0, net.forward(x)[0]) - y * net.forward(x)[0])
    for name in net.w:
        flat, at = net.w[name].reshape(-1), int(np.argmax(np.abs(g[name])))
        old, step = flat[at], 1e-5
        flat[at] = old + step
        more = loss()
        flat[at] = old - step
        less = loss()
        flat[at] = old
        assert abs((more - less) / (2 * step) - g[name].reshape(-1)[at]) < 1e-4, name


def test_labelled_findings_are_used(spark):
    rows = [(" y ", f"lamp{k:04d}-river-stone", "", False) for k in range(200)] + [("x ", f"Q{k:04d}Q{k * 7919 % 9973:04d}QZQZQZQZ", " y lamp", True) for k in range(200)]
    findings = spark.createDataFrame(rows + [(None, None, None, True), ("x", "y", "z", None)], "before string, value string, after string, secret boolean")
    docs = spark.createDataFrame([(1, "x Q1234Q5678QZQZQZQZ y lamp1234-river-stone", None, None, 0)], KINDS)
    (row,) = se.scan(docs, findings).collect()
    assert [(s.start, s.end) for s in row.secrets] == [(2, 20)]
