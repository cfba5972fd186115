"""Secret scans: fixed patterns, and a character convolutional network over all other candidates with their context.

Patterns.  ``assign`` (a name such as password or token, a sign and a value of six characters or more), ``access`` (AKIA and capitals or digits, 20
characters or more) and ``hex`` (24 hexadecimal digits or more), each leftmost without overlaps.  Their spans always stay.

Candidates.  Every maximal run of ``[A-Za-z0-9+/_.~-]``, without the signs at its ends, that has LEAST characters or more, a letter and a
digit, and does not touch a pattern's span.  The network sees all of it and CONTEXT bytes on either side: embedded characters and their
region (before, inside, after), one convolution over five characters, maxima of each region and the mean of the inside, a hidden layer and
a log-odd.  It is plain numpy; windows lie end to end, so candidates may have any length.  A candidate whose calibrated probability
reaches the threshold of its shape is a span of kind ``learned``.

Training.  From labelled findings (before, value, after, secret), or, where none are given, from ``examples``: values of public
credential formats and of look-alikes (identifiers, checksums, addresses, placeholders), put into snippets of the documents.  Shapes
occur on both sides, so neither prefixes nor alphabets decide alone.  MOST findings at most are used, those whose hash is least (a
documented bound; scanning covers all rows).  Half of them fit the network, a quarter its calibration (Platt) and the
thresholds: for each shape the highest that finds RECALL of the secrets; the rest is held out for ``Model.measured``.

Cases: null and empty texts have no spans; repeated texts get equal spans; a long text is scanned whole; without findings of both kinds nothing is
learned, and findings without a value or a label do not count; an empty table gives an empty table; spans come as one array column whose name is a parameter, and a column of that name in the
input, in any case, is replaced.  Starts and ends count code points, ends exclusive.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

KINDS = ("assign", "access", "hex", "learned")
LEAST, CONTEXT, RECALL = 16, 24, 0.98
MOST, EXAMPLES, SNIPPETS = 20_000, 6000, 400
SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
NAMED = re.compile(rb"passw|secret|token|api_?key", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _set(chars: str) -> np.ndarray:
    own = np.zeros(256, bool)
    own[list(chars.encode())] = True
    return own


DIGIT, LETTER, HEX = _set(string.digits), _set(string.ascii_letters), _set("0123456789abcdef")
TOKEN = _set(string.ascii_letters + string.digits + "+/_.~-")
INNER = _set(string.ascii_letters + string.digits)
#: Classes of bytes: those of printable ASCII, one for other white space, one beyond ASCII, and 0 for none.
CLASS = np.full(256, 97, np.int64)
CLASS[32:127] = np.arange(1, 96)
CLASS[[9, 10, 13]] = 96
N_CLASSES, EMBEDDED, WIDTH, FILTERS, HIDDEN = 98, 8, 5, 24, 24


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in bytes by the patterns for names and access keys."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pattern spans of all rows: row, kind's number, start and end (places in the data)."""
    raw, found = data.tobytes(), []
    hits = [m.start() for m in NAMED.finditer(raw)] + [m.start() for m in re.finditer(b"AKIA", raw)]
    for row in np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist() if hits else []:
        a, b = int(offsets[row]), int(offsets[row + 1])
        found += [(row, kind, a + s, a + e) for kind, s, e in base_spans(raw[a:b])]
    starts, ends, bounds = tc.spans(data, offsets, HEX)
    long = np.flatnonzero(ends - starts >= 24)
    rows = np.searchsorted(bounds, long, "right") - 1
    found += [(int(r), 2, int(starts[k]), int(ends[k])) for r, k in zip(rows, long, strict=True)]
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def candidates(data: np.ndarray, offsets: np.ndarray, taken: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of what the network is asked about; taken: spans_of()."""
    starts, ends, bounds = tc.spans(data, offsets, TOKEN)
    own = np.flatnonzero(ends - starts >= LEAST)
    rows, starts, ends = np.searchsorted(bounds, own, "right") - 1, starts[own], ends[own]
    total = lambda inside: np.concatenate([[0], np.cumsum(inside[data])])
    # Signs at the ends go: the next place from which an inner character starts, and the last behind one.
    inner = np.flatnonzero(INNER[data])
    if not len(inner):
        return (np.zeros(0, np.int64),) * 3
    first, last = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
    some = (first < len(inner)) & (last >= first)
    rows, first, last = rows[some], inner[first[some]], inner[last[some]] + 1
    digits, letters = total(DIGIT), total(LETTER)
    fits = (last - first >= LEAST) & (digits[last] > digits[first]) & (letters[last] > letters[first])
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, taken[2], 1)
    np.add.at(covered, taken[3], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1])])
    fits &= covered[last] == covered[first]
    return rows[fits], first[fits], last[fits]


@dataclass
class Windows:
    """Windows end to end: classes and region (0 before, 1 inside, 2 after) of each place, first place of each region of each window."""

    classes: np.ndarray
    region: np.ndarray
    edges: np.ndarray

    @classmethod
    def cut(cls, data: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, high: np.ndarray) -> Windows:
        """low, high: where each window's text begins and ends.  Two empty places stand at either end of a window."""
        a, b = np.maximum(low, starts - CONTEXT), np.minimum(high, ends + CONTEXT)
        sizes = np.stack([starts - a + 2, ends - starts, b - ends + 2], axis=1)
        edges = np.concatenate([[0], np.cumsum(sizes.ravel())])
        classes = np.zeros(edges[-1], np.int64)
        place = np.repeat(edges[:-1:3] + 2, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        classes[place] = CLASS[tc.gather(data, a, b - a)]
        return cls(classes, np.repeat(np.tile(np.arange(3), len(starts)), sizes.ravel()), edges[:-1].reshape(-1, 3))

    def part(self, own: np.ndarray) -> Windows:
        """Some of the windows."""
        ends = np.append(self.edges[1:, 0], len(self.classes))
        sizes = ends[own] - self.edges[own, 0]
        first = np.cumsum(sizes) - sizes
        return Windows(tc.gather(self.classes, self.edges[own, 0], sizes), tc.gather(self.region, self.edges[own, 0], sizes), self.edges[own] - self.edges[own, :1] + first[:, None])


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
        self.w = {
            "embed": rng.normal(0, 0.5, (N_CLASSES, EMBEDDED)).astype(np.float32), "conv": normal(WIDTH * (EMBEDDED + 3), FILTERS), "conv0": np.zeros(FILTERS, np.float32),
            "hidden": normal(4 * FILTERS, HIDDEN), "hidden0": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1), "out0": np.zeros(1, np.float32),
        }

    def forward(self, x: Windows):
        w, n, size = self.w, len(x.edges), len(x.classes)
        each = np.concatenate([w["embed"][x.classes], np.eye(3, dtype=np.float32)[x.region]], axis=1)
        padded = np.pad(each, ((WIDTH // 2, WIDTH // 2), (0, 0)))
        seen = np.concatenate([padded[k : k + size] for k in range(WIDTH)], axis=1)
        h = np.maximum(seen @ w["conv"] + w["conv0"], 0)
        edges = x.edges.ravel()
        most = np.maximum.reduceat(h, edges, axis=0) if n else np.zeros((0, FILTERS), np.float32)
        length = np.diff(np.append(edges, size))
        mean = (np.add.reduceat(h, edges, axis=0)[1::3] / length[1::3, None]) if n else np.zeros((0, FILTERS), np.float32)
        pooled = np.concatenate([most.reshape(n, 3 * FILTERS), mean], axis=1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden0"], 0)
        return (hidden @ w["out"] + w["out0"])[:, 0], (seen, h, most, length, pooled, hidden)

    def gradients(self, x: Windows, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        w, n = self.w, len(y)
        score, (seen, h, most, length, pooled, hidden) = self.forward(x)
        d = ((_share(score) - y) / n).astype(np.float32)[:, None]
        g = {"out": hidden.T @ d, "out0": d.sum(0)}
        d = (d @ w["out"].T) * (hidden > 0)
        g |= {"hidden": pooled.T @ d, "hidden0": d.sum(0)}
        d = d @ w["hidden"].T
        of_most, of_mean = d[:, : 3 * FILTERS].reshape(-1, FILTERS), np.zeros((3 * n, FILTERS), np.float32)
        of_mean[1::3] = d[:, 3 * FILTERS :] / length[1::3, None]
        top = (h == np.repeat(most, length, axis=0)).astype(np.float32)  # equal maxima share what goes back
        top /= np.repeat(np.add.reduceat(top, x.edges.ravel(), axis=0), length, axis=0)
        back = np.repeat(of_most, length, axis=0) * top + np.repeat(of_mean, length, axis=0)
        back *= h > 0
        g |= {"conv": seen.T @ back, "conv0": back.sum(0), "embed": np.zeros_like(w["embed"])}
        back = back @ w["conv"].T
        size, wide = len(h), EMBEDDED + 3
        each = np.zeros((size + WIDTH - 1, wide), np.float32)
        for k in range(WIDTH):
            each[k : k + size] += back[:, k * wide : (k + 1) * wide]
        np.add.at(g["embed"], x.classes, each[WIDTH // 2 : WIDTH // 2 + size, :EMBEDDED])
        return g

    def fit(self, x: Windows, y: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam steps over shuffled batches, 400 at least."""
        epochs = max(epochs, -(-400 * batch // len(y)))
        rng, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                own, step = order[at : at + batch], step + 1
                for k, g in self.gradients(x.part(own), y[own]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.w[k] -= rate * (0.5 if epoch > epochs // 2 else 1) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)


SHAPES = ("dotted", "signed", "joined", "capitals", "plain")


def shape_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of SHAPES each candidate has: with dots, with one of ``+/~``, with ``_`` or ``-``, without small letters, or none of these."""
    has = lambda chars: (lambda c: c[ends] > c[starts])(np.concatenate([[0], np.cumsum(_set(chars)[data])]))
    return np.select([has("."), has("+/~"), has("_-"), ~has(string.ascii_lowercase)], [0, 1, 2, 3], 4)


@dataclass
class Model:
    network: Network | None = None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(SHAPES), 2.0))
    measured: dict = field(default_factory=dict)

    def probability(self, x: Windows) -> np.ndarray:
        return _share(self.slope * self.network.forward(x)[0].astype(np.float64) + self.shift)

    def judge(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Whether each candidate is a secret, and its probability."""
        if self.network is None or not len(rows):
            return np.zeros(len(rows), bool), np.zeros(len(rows))
        p = np.concatenate([self.probability(Windows.cut(data, offsets[r], s, e, offsets[r + 1])) for r, s, e in ((rows[k : k + at_once], starts[k : k + at_once], ends[k : k + at_once]) for k in range(0, len(rows), at_once))])
        return p >= self.thresholds[shape_of(data, starts, ends)], p


def train(findings: list[tuple[str, str, str, bool]], seed: int = 11) -> Model:
    """Fit from (before, value, after, secret)."""
    y = np.array([bool(f[3]) for f in findings], np.float64)
    if not 0 < y.sum() < len(y):
        return Model()
    parts = [[s.encode() for s in f[:3]] for f in findings]
    data = np.frombuffer(b"".join(s for p in parts for s in p), np.uint8)
    edges = np.cumsum([len(s) for p in parts for s in p])
    low, starts, ends, high = np.concatenate([[0], edges[2:-1:3]]), edges[0::3], edges[1::3], edges[2::3]
    x, shape = Windows.cut(data, low, starts, ends, high), shape_of(data, starts, ends)
    order = np.random.default_rng(seed).permutation(len(y))
    fitted, tuned, held = np.split(order, [len(y) // 2, len(y) * 3 // 4])
    model = Model(Network())
    model.network.fit(x.part(fitted), y[fitted])
    model.slope, model.shift = platt(model.network.forward(x.part(tuned))[0], y[tuned])
    p = model.probability(x.part(tuned))
    lowest = lambda own: np.sort(own)[int((1 - RECALL) * len(own))] if len(own) else 0.5
    for k in range(len(SHAPES)):
        own = p[(y[tuned] > 0) & (shape[tuned] == k)]
        model.thresholds[k] = lowest(own if len(own) >= 20 else p[y[tuned] > 0])
    p = model.probability(x.part(held))
    said, true = p >= model.thresholds[shape[held]], y[held] > 0
    model.measured = {"n": len(held), "recall": said[true].mean(), "false_share": said[~true].mean(), "auc": auc(p, true), "mean_p": p.mean(), "share": true.mean()}
    return model


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds, by Newton steps on the smoothed logistic loss."""
    x = np.stack([score.astype(np.float64), np.ones(len(score))], axis=1)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = _share(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def auc(p: np.ndarray, true: np.ndarray) -> float:
    """Share of pairs of a secret and another in the right order."""
    _, rank = np.unique(p, return_inverse=True)
    size = np.bincount(rank)
    mid = np.cumsum(size) - (size - 1) / 2
    return float((mid[rank][true].sum() - true.sum() * (true.sum() + 1) / 2) / max(1, true.sum() * (~true).sum()))


#: Prefixes of public credential formats, and what stands before credentials and before look-alikes.
PREFIXES = ("ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "SG.", "npm_", "hf_", "dop_v1_", "shpat_", "pypi-")
CREDENTIAL_LEADS = ("Authorization: Bearer ", "Bearer ", "pwd=", "pass: ", "passphrase ", "credential ", "auth_key ", "access key is ", "private key ", "export PAT=", "key=", "login with ", "sig=", "sas ", "client id and key ")
OTHER_LEADS = ("commit ", "sha256:", "sha1 ", "md5 ", "checksum ", "etag ", "integrity ", "data:image/png;base64,", "id ", "ref ", "see ", "file ", "uuid ", "serial no. ", "build ", "order ", "IBAN ", "version ", "trace ")


def examples(snippets: list[str], n: int = EXAMPLES, seed: int = 3, without: tuple[str, ...] = ()) -> list[tuple[str, str, str, bool]]:
    """n labelled findings, half of them secrets; without: prefixes not to use."""
    rng = np.random.default_rng(seed)
    pick = lambda own: own[int(rng.integers(len(own)))]
    small, capitals, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, upper_hex = string.ascii_letters + digits, digits + "ABCDEF"
    chars = lambda own, size: "".join(own[k] for k in rng.integers(0, len(own), size))
    size = lambda a, b: int(rng.integers(a, b + 1))
    words = sorted({w for s in snippets for w in re.findall("[A-Za-z]{3,12}", s)}) or ["alpha", "beta", "gamma"]
    blob = lambda a, b: chars(alnum + "+/", size(a, b))
    prefixes = [p for p in PREFIXES if p not in without]
    secret = (
        lambda: pick(prefixes) + chars(alnum, size(20, 40)), lambda: pick(prefixes) + chars(alnum, size(20, 40)),
        lambda: f"xoxb-{chars(digits, 12)}-{chars(digits, 12)}-{chars(alnum, 24)}",
        lambda: f"eyJ{chars(alnum + '_-', size(15, 40))}.eyJ{chars(alnum + '_-', size(20, 80))}.{chars(alnum + '_-', 43)}",
        lambda: blob(36, 64), lambda: blob(42, 43), lambda: chars(alnum, size(20, 48)), lambda: chars(alnum, size(20, 48)),
        lambda: chars(capitals + digits, size(24, 40)), lambda: chars(upper_hex, pick((32, 40, 64))), lambda: chars(small + digits, size(24, 40)),
        lambda: pick(words).capitalize() + chars(digits + "-_.~", size(3, 6)) + chars(alnum, size(8, 12)), lambda: f"{chars(alnum, 8)}-{chars(alnum, 8)}-{chars(alnum, 8)}",
    )
    uuid = lambda own: "-".join(chars(own, k) for k in (8, 4, 4, 4, 12))
    other = (
        lambda: uuid(digits + "abcdef"), lambda: uuid(upper_hex),
        lambda: f"{pick(words)}.{pick(words)}.example.{pick(('com', 'org', 'net'))}/{pick(words)}/{size(1, 9999)}",
        lambda: f"{pick(words)}/{pick(words)}/{pick(words)}{size(1, 99)}.{pick(('py', 'txt', 'html', 'tar.gz', 'java', 'png'))}",
        lambda: f"{pick(words)}-{pick(words)}-{size(0, 20)}.{size(0, 20)}.{size(0, 99)}", lambda: f"20{size(10, 29)}-0{size(1, 9)}-1{size(0, 9)}T1{size(0, 9)}.{size(10, 59)}.{size(10, 59)}Z",
        lambda: "".join(pick(words).capitalize() for _ in range(3)) + str(size(1, 64)), lambda: "_".join(pick(words) for _ in range(4)) + f"_{size(1, 99)}",
        lambda: "-".join(pick(words) for _ in range(3)) + f"-{size(1, 2030)}", lambda: pick(("DE", "FR", "ES", "GB")) + chars(digits, 20), lambda: "".join(pick(words) for _ in range(3)) + chars(digits, size(1, 3)),
        lambda: f"{pick(('your', 'my', 'example', 'dummy', 'sample'))}-{pick(('key', 'value', 'access', 'auth'))}-{pick(('here', 'goes', 'placeholder'))}-{chars('0', size(1, 4))}{size(1, 9)}",
        lambda: chars("X", size(12, 24)) + chars(digits, 4), lambda: f"{chars(digits, 4)}-{chars(digits, 4)}-{chars(digits, 4)}-{pick(words)}",
    )
    either = (lambda: blob(40, 64), lambda: blob(42, 43), lambda: chars(upper_hex, pick((32, 40, 64))), lambda: chars(alnum, size(20, 40)))
    cut = lambda: (lambda s: s[: size(0, len(s))])(pick(snippets)) if snippets else ""
    out = []
    while len(out) < n:
        is_secret = len(out) % 2 == 0
        shared = rng.random() < 0.25  # one shape for both, told apart by what stands before
        value = pick(either if shared else secret if is_secret else other)()
        named = shared or rng.random() < 0.5
        lead = pick(CREDENTIAL_LEADS if is_secret else OTHER_LEADS) if named else pick(("", " ", "\n", '"', "("))
        if not is_secret and not named and rng.random() < 0.1:
            lead, value = f"{pick(words)}.{size(1, 99)}@", f"{pick(words)}{size(0, 99)}.{pick(('example', *words))}.{pick(('com', 'org', 'net'))}"
        if LEAST <= len(value) and re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            out.append((f"{cut()} {lead}"[-CONTEXT:], value, f"{pick((' ', chr(10), '. ', '), ', chr(34)))}{cut()}"[:CONTEXT], is_secret))
    return out


def snippets_of(docs: DataFrame, text_col: str, most: int = SNIPPETS, size: int = 60) -> list[str]:
    """Pieces of ``size`` characters of at most ``most`` documents, those with the least hash, from a place that the hash chooses."""
    text = F.col(text_col)
    at = F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.length(text), F.lit(1))).cast("int") + 1
    rows = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("h"), F.substring(text, at, F.lit(size)).alias("s"))
    return [r.s for r in rows.orderBy("h", "s").limit(most).collect()]


def scan(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", into: str = "secrets", keep: list[str] | None = None, most: int = MOST) -> DataFrame:
    """Columns ``keep`` (all, if not given) and ``into``: spans (kind, start, end, score) by start, then kind; score: the network's probability.

    findings: before, value, after (strings) and secret (boolean).
    """
    keep = tc.others(docs.columns if keep is None else keep, into)
    text, found = tc.free([*keep, into], "text_", "spans_")
    if findings is None:
        labelled = examples(snippets_of(docs, text_col))
    else:
        columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "value", "after")]
        rows = findings.where("secret is not null and length(value) > 0").select(*columns, "secret")
        labelled = [tuple(r) for r in rows.orderBy(F.xxhash64("before", "value", "after"), "before", "value", "after", "secret").limit(most).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled))  # a few thousand numbers, whatever the input

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            col = tc.text_column(batch, text)
            for i, j in tc.slices(col):
                own = batch.slice(i, j - i)
                kinds, starts, ends, scores, sizes = _found(*tc.raw(col.slice(i, j - i)), model)
                fields = [pa.DictionaryArray.from_arrays(pa.array(kinds, pa.int32()), pa.array(KINDS)).cast(pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(scores, mask=np.isnan(scores))]
                spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind_of)))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), spans], [*keep, found])

    ddl = ", ".join(x for x in (tc.kinds(docs, keep), f"`{found}` {SPAN}") if x)
    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(of, ddl).select(*keep, F.col(found).alias(into))


def _found(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple:
    """Kind's number, start and end (code points of the row) and score of all spans by row, start and kind; first span of each row."""
    taken = spans_of(data, offsets)
    rows, starts, ends = candidates(data, offsets, taken)
    said, p = model.judge(data, offsets, rows, starts, ends)
    row = np.concatenate([taken[0], rows[said]])
    kind = np.concatenate([taken[1], np.full(said.sum(), 3)])
    a, b = np.concatenate([taken[2], starts[said]]), np.concatenate([taken[3], ends[said]])
    score = np.concatenate([np.full(len(taken[0]), np.nan), p[said]])
    order = np.lexsort((kind, a, row))
    row, kind, a, b, score = row[order], kind[order], a[order], b[order], score[order]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = points[offsets[row]]
    return kind, points[a] - begin, points[b] - begin, score, np.searchsorted(row, np.arange(len(offsets)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
