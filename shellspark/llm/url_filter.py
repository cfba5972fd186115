"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Labels.  The trees learn from labelled urls that the caller gives (columns url and block).  Without such, they learn from the urls of the pages
themselves, labelled by ``seeded`` (block, where a part of the host, between dots and hyphens, is a word of ``SEEDS``), together with
``examples``: urls made on the pages' domains by known forms of unwanted ones (a seed word alone or with others, random hosts, runs of
digits, long click parameters) and of others of like forms (hyphenated names, numbers, parameters, seed words in the path).  Both kinds
have urls with and without hyphens, digits, parameters and deep paths, so no single feature tells them apart.  Labels are never made from the rules.

Features.  Lengths of url, host, path and the host's longest label, path depth, labels of the host, digit ratio, other-character ratio, entropy
of the url's and of the host's characters, query parameters and their length, fragment, hyphens and digits of the host, share of
vowels in the host; for two suffixes of the host (its last label and its last two) how many labelled rows have it and
its smoothed share of blocked ones; and of the host's parts the highest and the mean share of blocked rows, and how many labelled rows
know.  These counts cover all labelled rows and are a sorted hash store that workers map.  For fitting they are out of fold: rows
are cut into ``FOLDS`` folds by host, and a row's counts leave out its own fold.

The trees are fitted on the driver from about ``MOST_TRAINING`` of the distinct labelled urls at most, those whose hash is below a
threshold (a documented bound; all other steps cover all rows).

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule, and is judged by the trees; without labelled urls, or with
labels of one kind only, the trees give that share (none: allow); a url labelled both ways is two rows; equal urls get equal verdicts; a
url may have any length; an empty table gives an empty table; columns of the input with the names of results, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashstore as hs
from . import textcore as tc

MOST_TRAINING, TREES, DEPTH, RATE, BINS, FOLDS, SMOOTH, SMOOTH_PART = 20_000, 60, 4, 0.2, 32, 5, 20, 1
#: Words by which ``seeded`` labels a host.
SEEDS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "casinos", "drugs", "gambling", "loans", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "tracker", "viagra", "warez", "xxx")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of urls that are looked at together.
PART = 256 << 10
FEATURES = (
    "length", "host_length", "path_length", "longest_label", "depth", "host_labels", "digit_ratio", "other_ratio", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "host_hyphens", "host_digits", "host_vowels", "suffix1_count", "suffix1_share", "suffix2_count", "suffix2_share",
    "part_highest", "part_mean", "parts_known",
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWERED), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null, null: none); rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def seeded(urls: DataFrame, url_col: str = "url", words: tuple[str, ...] = SEEDS) -> DataFrame:
    """url and block: has the host a part that is one of the words?  Rows without a host have no label."""
    host = host_path(F.col(url_col))[0]
    block = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))
    return urls.select(F.col(url_col).alias("url"), block.alias("block")).where(host != "")


def suffix_keys(host: Column) -> tuple[Column, Column]:
    """Keys of the host's last label and of its last two."""
    return tuple(F.xxhash64(F.lit(k), F.substring_index(host, ".", -k)) for k in (1, 2))


def keys_of(host: Column) -> Column:
    """Keys of the two suffixes, then of the host's parts without the last label, each once."""
    parts = F.array_distinct(F.split(F.regexp_replace(host, r"\.[^.]*$", ""), "[.-]"))
    return F.concat(F.array(*suffix_keys(host)), F.transform(parts, lambda p: F.xxhash64(F.lit(0), p)))


#: Plain words of hosts, fixed: those of the examples that are not unwanted.
PLAIN = (
    "my", "company", "data", "science", "news", "blog", "docs", "shop", "home", "garden", "city", "library", "music", "school", "travel", "health", "open", "source", "world",
    "green", "river", "weather", "photo", "book", "kitchen", "design", "art", "sport", "local", "north", "family", "team", "cloud", "maps", "forum", "wiki", "support", "bank",
)
EXAMPLES, HOSTS = 6000, 400


def examples(hosts: list[str], n: int = EXAMPLES, seed: int = 4) -> list[tuple[str, bool, str]]:
    """n labelled urls with their form; hosts: some of the pages', for their domains and words."""
    rng = np.random.default_rng(seed)
    pick = lambda own: own[int(rng.integers(len(own)))]
    chars = lambda own, a, b: "".join(pick(own) for _ in range(int(rng.integers(a, b + 1))))
    number = lambda a, b: str(int(rng.integers(a, b)))
    domains = sorted({".".join(h.split(".")[-2:]) for h in hosts if h.count(".")}) or ["example.com", "example.net", "example.org"]
    # The pages' own hosts have one-off words: half of what the examples use, so being known is no sign of either kind.
    words = [*PLAIN, *sorted({w for h in hosts for w in h.replace("-", ".").split(".")[:-2]} - {*SEEDS, "www", "m", ""})[: len(PLAIN)]]
    alnum, hexa = LOWERED + "0123456789", "0123456789abcdef"
    plain = lambda: pick(words)
    query = lambda k, own, a, b: "?" + "&".join(f"{pick(('id', 'ref', 'page', 'utm_source', 'cid', 'sub', 'src', 'q'))}={chars(own, a, b)}" for _ in range(k))
    page = lambda: f"/{pick(('en', 'de', 'fr', 'es'))}/{number(1, 9999)}{pick(('', '/', '.html', '#top', '?page=2&ref=x', '?utm_source=feed'))}"
    tail = lambda: pick((lambda: "/", lambda: "", page, page, lambda: f"/{plain()}-{plain()}/{plain()}-{number(1, 99)}"))()
    forms = {
        True: {
            "word": lambda: (pick(SEEDS), tail()), "word-first": lambda: (f"{pick(SEEDS)}-{plain()}", tail()), "word-last": lambda: (f"{plain()}-{pick(SEEDS)}", tail()),
            "word-between": lambda: (f"{plain()}-{pick(SEEDS)}-{plain()}", tail()), "random": lambda: (chars(alnum, 12, 24), tail()), "digits": lambda: (f"{plain()}{chars('0123456789', 4, 8)}", tail()),
            "clicks": lambda: (plain(), f"/{plain()}{query(int(rng.integers(4, 9)), hexa, 8, 32)}"),
        },
        False: {
            "plain": lambda: (plain(), tail()), "plain-pair": lambda: (f"{plain()}-{plain()}", tail()), "plain-triple": lambda: (f"{plain()}-{plain()}-{plain()}", tail()),
            "numbered": lambda: (f"{plain()}{number(1, 99)}", tail()), "joined": lambda: (plain() + plain() + plain(), tail()), "parameters": lambda: (plain(), f"/{plain()}{query(int(rng.integers(1, 4)), alnum, 1, 9)}"),
            "word-in-path": lambda: (plain(), f"/{plain()}/{pick(SEEDS)}-{plain()}-{number(1, 99999)}"), "deep": lambda: (plain(), "".join(f"/{plain()}" for _ in range(int(rng.integers(3, 8)))) + f"/{number(1, 10**8)}"),
        },
    }
    out = []
    for k in range(n):
        block = k % 2 == 0
        form = pick(sorted(forms[block]))
        host, rest = forms[block][form]()
        out.append((f"{pick(('http', 'https'))}://{pick(('', '', 'www.', 'm.'))}{host}.{pick(domains)}{rest}", block, form))
    return out


def labelled_by_default(pages: DataFrame, url_col: str) -> DataFrame:
    """The pages' urls by ``seeded`` and the examples."""
    host = host_path(F.col(url_col))[0]
    hosts = [r.h for r in pages.select(host.alias("h")).where("h <> ''").distinct().orderBy(F.xxhash64("h"), "h").limit(HOSTS).collect()]
    made = [(u, b) for u, b, _ in examples(hosts)]
    return seeded(pages, url_col).union(pages.sparkSession.createDataFrame(made, "url string, block boolean"))


def _count(data: np.ndarray, offsets: np.ndarray, chars: bytes) -> np.ndarray:
    own = np.zeros(256, np.int64)
    own[list(chars)] = 1
    return tc.totals(own[data], offsets).astype(np.float64)


def _entropy(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    seen = np.bincount(row * 256 + data, minlength=256 * n).reshape(-1, 256) / np.maximum(size, 1)[:, None]
    return -(seen * np.log2(np.where(seen > 0, seen, 1))).sum(axis=1)


def _longest(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of each host's longest label."""
    label = np.ones(256, dtype=bool)
    label[46] = False
    starts, ends, bounds = tc.spans(data, offsets, label)
    out = np.zeros(len(offsets) - 1)
    np.maximum.at(out, np.repeat(np.arange(len(out)), np.diff(bounds)), ends - starts)
    return out


def lexical(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """The features but those of the suffixes."""
    (data, offsets), h, p = tc.raw(url), tc.raw(host), tc.raw(path)
    size = np.diff(offsets).astype(np.float64)
    some, host_size = np.maximum(size, 1), np.diff(h[1])
    digits, letters = (_count(data, offsets, x) for x in (b"0123456789", (LOWERED + UPPER).encode()))
    columns = (
        size, host_size, np.diff(p[1]), _longest(*h), _count(*p, b"/"), _count(*h, b".") + (host_size > 0), digits / some, (size - digits - letters) / some,
        _entropy(data, offsets), _entropy(*h), _count(data, offsets, b"&?"), np.maximum(0, size - host_size - np.diff(p[1]) - 8), _count(data, offsets, b"#"), _count(*h, b"-"),
        _count(*h, b"0123456789"), _count(*h, b"aeiouy") / np.maximum(host_size, 1),
    )
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def with_counts(x: np.ndarray, counts: np.ndarray, blocked: np.ndarray, first: np.ndarray, mean: float) -> np.ndarray:
    """All features.  counts, blocked: of labelled rows, for each row's two suffixes and then its parts; first: where each row's begin."""
    share = (blocked + SMOOTH * mean) / (counts + SMOOTH)
    part = (blocked + SMOOTH_PART * mean) / (counts + SMOOTH_PART)
    part[first] = part[first + 1] = 0
    n = np.diff(np.append(first, len(counts))) - 2
    known = (counts > 0).astype(np.float64)
    known[first] = known[first + 1] = 0
    sums = [np.add.reduceat(v, first) if len(first) else v for v in (part, known)]
    highest = np.maximum.reduceat(part, first) if len(first) else part
    columns = [np.log1p(counts[first]), share[first], np.log1p(counts[first + 1]), share[first + 1], highest, sums[0] / np.maximum(n, 1), sums[1]]
    return np.concatenate([x, np.stack(columns, axis=1)], axis=1)


@dataclass
class Model:
    """Trees of one depth as arrays: feature and threshold of each inner node, value of each leaf; and where the suffixes' counts are."""

    prior: float = -10.0
    mean: float = 0.0
    trees: list = field(default_factory=list)
    path: str = ""
    bits: int = 0

    def suffixes(self) -> hs.Store:
        return hs.Store(self.path, self.bits, {"key": "u8", "n": "i8", "blocked": "i8"})

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of block."""
        out = np.full(len(x), self.prior)
        for tree in self.trees:
            out += _leaf(tree, x)
        return out


def _leaf(tree: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, leaf = tree
    node = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return leaf[node - len(feature)]


def fit(x: np.ndarray, y: np.ndarray, model: Model | None = None) -> Model:
    """Boosted trees for logistic loss, by Newton steps over feature quantiles."""
    model = model or Model()
    if not len(y):
        return model
    model.prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        # Rare blocked urls have quantiles of their own.
        cuts = [np.unique(np.concatenate([c, np.quantile(x[y > 0, f], np.linspace(0, 1, 9), method="lower") - 1e-9])) for f, c in enumerate(cuts)]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        out = np.full(len(y), model.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-out))
            model.trees.append(_tree(bins, cuts, p - y, np.maximum(p * (1 - p), 1e-6)))
            out += _leaf(model.trees[-1], x)
    return model


def _tree(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, ridge: float = 1.0):
    inner = (1 << DEPTH) - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(g), np.int64)
    for k in range(inner):
        own = np.flatnonzero(node == k)
        best = (1e-9, 0, np.inf, 0)
        total = (g[own].sum(), h[own].sum())
        for f, cut in enumerate(cuts):
            left_g = np.cumsum(np.bincount(bins[own, f], g[own], len(cut) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[own, f], h[own], len(cut) + 1))[:-1]
            if len(cut):
                gain = left_g**2 / (left_h + ridge) + (total[0] - left_g) ** 2 / (total[1] - left_h + ridge) - total[0] ** 2 / (total[1] + ridge)
                b = int(gain.argmax())
                best = max(best, (float(gain[b]), -f, float(cut[b]), b), key=lambda t: t[:2])
        feature[k], threshold[k] = -best[1], best[2]
        right = bins[own, feature[k]] > best[3] if np.isfinite(best[2]) else np.zeros(len(own), bool)
        node[own] = 2 * k + 1 + right
    leaf = np.zeros(inner + 1)
    for k in range(inner + 1):
        own = node == inner + k
        leaf[k] = -RATE * g[own].sum() / (h[own].sum() + ridge)
    return feature, threshold, leaf


def train(labelled: DataFrame, most: int = MOST_TRAINING) -> Model:
    """Fit from rows (url, block boolean)."""
    spark = labelled.sparkSession
    host, path = host_path(F.col("url"))
    rows = labelled.where("block is not null").select("url", host.alias("host"), path.alias("path"), "block")
    rows = rows.withColumns({"keys": keys_of(F.col("host")), "fold": F.pmod(F.xxhash64("host", F.lit(3)), F.lit(FOLDS))})
    model = Model(path=hs.shared_dir(spark, "suffixes"))
    each = rows.select(F.explode("keys").alias("key"), "fold", F.col("block").cast("long").alias("b"))
    folds = f"{model.path}-folds"
    each.groupBy("key", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("blocked")).write.parquet(folds)
    counts = spark.read.parquet(folds)
    model.bits = hs.write(counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")), model.path)
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum(F.col("block").cast("long"))).first()
    if n:
        model.mean = blocked / n
        # The least hashes of distinct urls: about ``most`` of them, found without sending more than these.
        distinct = rows.agg(F.approx_count_distinct("url", 0.02)).first()[0]
        below = min((1 << 63) - 1, int(0.95 * most / max(1, distinct) * (1 << 63)))
        sample = rows.where(F.xxhash64("url").bitwiseAND((1 << 63) - 1) <= below).distinct().orderBy(F.xxhash64("url"), "url", "block").limit(most)
        sample = sample.collect()
        wanted = spark.createDataFrame([(k,) for k in sorted({k for r in sample for k in r["keys"]})] or [(0,)], "key long")
        found: dict[int, list] = {}
        for r in counts.join(F.broadcast(wanted), "key").collect():  # the keys of ``most`` urls in FOLDS folds
            found.setdefault(r.key, []).append((r.fold, r.n, r.blocked))
        flat = [(sum(m for f, m, _ in own if f != r.fold), sum(m for f, _, m in own if f != r.fold)) for r in sample for own in (found.get(k, []) for k in r["keys"])]
        sizes = np.array([len(r["keys"]) for r in sample], np.int64)
        out_of_fold = np.array(flat, np.float64).reshape(-1, 2)
        x = lexical(*(pa.array([r[c] or "" for r in sample], pa.large_string()) for c in ("url", "host", "path")))
        x = with_counts(x, out_of_fold[:, 0], out_of_fold[:, 1], np.cumsum(sizes) - sizes, model.mean)
        fit(x, np.array([r.block for r in sample], np.float64), model)
    hs.remove(spark, folds)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if not given), host, path, rule, verdict and score (the trees' probability of block).

    labelled: urls with a boolean column ``block``; by default the pages' own urls by ``seeded``, and ``examples``.
    """
    results = ("host", "path", "rule", "verdict", "score")
    keep = tc.others(pages.columns if keep is None else keep, *results)
    u, h, p, r, v, keys = tc.free([*keep, *results], "url_", "host_", "path_", "rule_", "verdict_", "keys_")
    host, path = host_path(F.col(url_col))
    rows = pages.select(*keep, F.col(url_col).alias(u), host.alias(h), path.alias(p))
    rule, verdict = rule_of(F.col(h), F.col(p), rules)
    rows = rows.withColumns({r: rule, v: verdict, keys: keys_of(F.col(h))})
    model = train(labelled_by_default(pages, url_col) if labelled is None else labelled.select("url", "block"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees, whatever the input

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        store = model.suffixes()
        for batch in batches:
            url, host, path = (tc.text_column(batch, c) for c in (u, h, p))
            for i, j in tc.slices(url, PART):
                part = batch.slice(i, j - i)
                each = part.column(keys)
                known, n, blocked = store.lookup(each.flatten().to_numpy().view(np.uint64), "n", "blocked")
                first = each.offsets.to_numpy()[:-1].astype(np.int64) - each.offsets[0].as_py()
                x = lexical(*(c.slice(i, j - i) for c in (url, host, path)))
                x = with_counts(x, n.astype(np.float64), blocked.astype(np.float64), first, model.mean)
                score = 1 / (1 + np.exp(-model.score(x)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keep, h, p, r, v)), pa.array(score)], [*keep, h, p, r, v, "score"])

    out = rows.mapInArrow(of, ", ".join(x for x in (tc.kinds(pages, keep), f"`{h}` string, `{p}` string, `{r}` string, `{v}` string, score double") if x))
    by_model = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keep, F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), F.coalesce(F.col(v), by_model).alias("verdict"), "score")
