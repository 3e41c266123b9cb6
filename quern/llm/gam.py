"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text. Training boosts shallow trees in cycles, one feature at a time, each
on the residuals of all before it; a tree of one feature is a step function over its bins, so their sum is a lookup
table. Pairs whose joint table explains most of what is left get tables of two features. A score is the logistic of
the sum of looked-up values: bin indices by binary search and additions, for a whole batch at a time.

Training takes at most `train_rows` labelled documents, those first by a hash of doc_id (20,000 rows of 16 numbers:
a documented bound, so they fit the driver); scoring covers every document. The model is a few kilobytes.

Defined results: a null text is scored as the empty text, and both get the score that the tables give to zero counts.
Rows with a null doc_id are scored, and are not held out. Repeated labels of a document count once, the smaller one.
Without labels of both classes, the score is the smoothed share of good labels (0.5 with none). Columns named like
the results are replaced by score_documents; keep_good returns its input's columns. A very long text is counted to its
end. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_texts, written

NAMES = (
    "log_words", "word_length", "long_words", "distinct_words", "distinct_pairs", "top_word", "short_words", "capitals", "digits",
    "symbols", "bars", "exclamations", "stops", "commas", "lines", "equal_lines",
)

_ORD = {c: ord(c) for c in "#*$%&<>|!.,\n"}


def features(text: str | None) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(words)
    lengths = np.fromiter(map(len, words), np.int64, seen)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    upper, lower = n[65:91].sum(), n[97:123].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(seen)), float(lengths.mean()), float((lengths > 12).mean()), len(distinct) / seen,
        len(set(zip(words, words[1:], strict=False))) / max(1, seen - 1), max(distinct.values()) / seen, float((lengths <= 3).mean()),
        float(upper / max(1, upper + lower)), float(n[48:58].sum() / seen), float(sum(n[_ORD[c]] for c in "#*$%&<>") / seen), float(n[_ORD["|"]] / seen),
        float(n[_ORD["!"]] / seen), float(n[_ORD["."]] / seen), float(n[_ORD[","]] / seen), float(n[_ORD["\n"]] / seen), 1 - len(set(lines)) / len(lines),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; pairs have coarser edges of their own."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of the values, and of the distinct values: so rare ones beyond a common value get bins too."""
    at = np.arange(1, bins) / bins
    return np.unique(np.concatenate([np.quantile(x, at), np.quantile(np.unique(x), at)]))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _step(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values over bins of the best step function, split greedily into at most `leaves` runs."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            k = np.arange(lo + 1, hi)
            if not len(k):
                continue
            gl, hl, gr, hr = cg[k] - cg[lo], ch[k] - ch[lo], cg[hi] - cg[k], ch[hi] - ch[k]
            gains = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge), 0)
            if gains.max() > best:
                best, at = gains.max(), k[gains.argmax()]
        if at is None:
            break
        cuts = sorted([*cuts, at])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _corner(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree of one cut on each axis (four leaves) over a table of two features."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (g, h))
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            part = lambda c: np.array([c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]])  # noqa: B023, E731
            gs, hs = part(cg), part(ch)
            if (hs < least).any():
                continue
            if (gain := _gain(gs, hs, ridge).sum() - _gain(cg[-1, -1], ch[-1, -1], ridge)) > best:
                v = gs / (hs + ridge)
                best, out = gain, np.block([[np.full((i, j), v[0]), np.full((i, g.shape[1] - j), v[1])], [np.full((g.shape[0] - i, j), v[2]), np.full((g.shape[0] - i, g.shape[1] - j), v[3])]])
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, pair_rounds: int = 30, n_pairs: int = 6, bins: int = 32, pair_bins: int = 8, leaves: int = 3, rate: float = 0.1, ridge: float = 1.0, least: float = 0.5) -> Model:
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    p = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(p)]
    model.coarse = [_edges(x[:, j], pair_bins) for j in range(p)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.start)
    chance = lambda: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        for j in range(p):
            q = chance()
            n = len(model.tables[j])
            step = rate * _step(np.bincount(at[j], y - q, n), np.bincount(at[j], q * (1 - q), n), leaves, ridge, least)
            model.tables[j] += step
            z += step[at[j]]
    places = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def joint(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, shape = chance(), (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        flat = places[a] * shape[1] + places[b]
        return flat, np.bincount(flat, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(flat, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_corner(*joint(a, b)[1:], ridge, least)[0], a, b) for a in range(p) for b in range(a + 1, p)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            flat, g, h = joint(a, b)
            step = rate * _corner(g, h, ridge, least)[1]
            table += step
            z += step.ravel()[flat]
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, **settings) -> Model:
    """A model of labels(doc_id, quality), from labelled documents that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")
    known = F.broadcast(known.withColumnRenamed("doc_id", "id"))  # train_rows rows at most
    texts = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("id")).select("quality", "text")
    derive = lambda: lambda texts: {"x": [features(t) for t in texts]}
    # a document in several rows could exceed the bound
    rows = map_texts(texts, derive, "x array<double>", keep=("quality",)).limit(train_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(rows.column("quality").to_pylist(), float), **settings)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to doc_id, score."""

    def derive():
        return lambda texts: {"score": model.score(np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))).tolist()}

    return map_texts(docs, derive, "score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            good = model.score(np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))) >= least
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
