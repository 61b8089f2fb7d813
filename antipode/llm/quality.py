"""Quality of a text as an additive model of lookup tables.

One pass over the corpus measures every whole text (``FEATURES``: shares of character kinds,
repetition of words, phrases and lines, shape of words and lines). A generalised additive model with
pairwise interactions learns from the labelled ones: features are cut into bins, and boosting
visits them in turn, each visit adding a small step of a shallow tree over one feature's bins (or
over the bins of a pair) to that feature's table. Scoring looks bins up and adds.

Fitting holds at most ``max_rows`` labelled rows (a documented bound; chosen by a hash of the id
where there are more) as small numbers on the driver; everything else covers all rows.

Defined results: null and empty texts have features of value zero or none and are scored like any
other text. Labels other than 0 and 1, null ids and ids with both labels teach nothing; a table
without labels of both kinds gives every text the smoothed share of label 1. Repeated rows are
scored each. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import map_rows, materialize, uniform_of

MAX_ROWS = 100_000
BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PATIENCE, RATE, SMOOTH, LEAST_ROWS = 300, 25, 0.15, 1.0, 5

FEATURES = ("chars", "words", "lines", "word_chars", "longest_word", "line_words", "upper", "lower", "digits", "blank",
            "sentence_marks", "brackets", "signs", "beyond_ascii", "byte_entropy", "distinct_words", "once_words", "top_word",
            "distinct_trios", "alphabetic_words", "upper_words", "title_words", "odd_ends", "copied_lines", "ended_lines",
            "short_lines", "deflated")


def _kind(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_KINDS = {"upper": _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _kind("abcdefghijklmnopqrstuvwxyz"), "digits": _kind("0123456789"),
          "blank": _kind(" \t\n\x0b\x0c\r"), "sentence_marks": _kind(".,;:!?"), "brackets": _kind("()[]{}<>\"'"),
          "signs": _kind("#$%&*|@^~\\/_+=-`"), "beyond_ascii": np.arange(256) >= 128}


def measure(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text; shares of nothing are NaN."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    seen = Counter(words)
    share = lambda part, whole: part / whole if whole else float("nan")
    probability = counts[counts > 0] / max(size, 1)
    trios = max(n - 2, 0)
    copied = sum(len(x) * (k - 1) for x, k in Counter(lines).items())
    values = {
        "chars": float(np.log1p(len(text))), "words": float(np.log1p(n)), "lines": float(np.log1p(len(lines))),
        "word_chars": share(sum(map(len, words)), n), "longest_word": float(max(map(len, seen), default=0)),
        "line_words": share(n, len(lines)),
        **{kind: share(int(counts[mask].sum()), size) for kind, mask in _KINDS.items()},
        "byte_entropy": float(-(probability * np.log2(probability)).sum()) if size else float("nan"),
        "distinct_words": share(len(seen), n), "once_words": share(sum(k == 1 for k in seen.values()), n),
        "top_word": share(max(seen.values(), default=0), n),
        "distinct_trios": share(len(set(zip(words, words[1:], words[2:], strict=False))), trios),
        "alphabetic_words": share(sum(map(str.isalpha, words)), n), "upper_words": share(sum(map(str.isupper, words)), n),
        "title_words": share(sum(map(str.istitle, words)), n),
        "odd_ends": share(sum(k for w, k in seen.items() if not (w[-1].isalnum() or w[-1] in ".,;:!?")), n),
        "copied_lines": share(copied, sum(map(len, lines))),
        "ended_lines": share(sum(x.rstrip()[-1] in ".!?。！？" for x in lines), len(lines)),
        "short_lines": share(sum(len(x) < 30 for x in lines), len(lines)),
        "deflated": share(len(zlib.compress(raw, 1)), size),
    }
    return [values[f] for f in FEATURES]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            yield {"id": cols["id"], "x": [measure(t) for t in cols["text"].to_pylist()]}

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, x array<double>", work)


# --------------------------------------------------------------------- model

@dataclass
class AdditiveModel:
    """``edges`` per feature, one table per feature and per pair. Bin 0 is for features without a value."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        if self.tables:
            fine, coarse = _bins(x, self.edges), _bins(x, self.pair_edges)
            for f, table in enumerate(self.tables):
                total += table[fine[:, f]]
            for (a, b), table in self.pairs.items():
                total += table[coarse[:, a], coarse[:, b]]
        return _sigmoid(total)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts per feature, at quantiles of its values."""
    out = []
    for column in x.T:
        known = column[~np.isnan(column)]
        out.append(np.unique(np.quantile(known, np.arange(1, bins) / bins, method="lower")) if len(known) else np.empty(0))
    return out


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    for f, cuts in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(cuts, x[:, f], side="left"))
    return out


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int | None:
    """Bin at which to start the right side: the largest gain with enough rows on both sides."""
    if len(g) < 2:
        return None
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= LEAST_ROWS) & (n.sum() - nl >= LEAST_ROWS), gain, -np.inf)
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin of a tree with ``depth`` levels over the bins of one feature."""
    at = _cut(g, h, n) if depth else None
    if at is None:
        return np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _quarters(a: np.ndarray) -> np.ndarray:
    """Sums of the four quarters for every pair of cuts: shape (4, cuts, cuts)."""
    c = a.cumsum(0).cumsum(1)
    left, top, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
    corner = c[:-1, :-1]
    return np.stack([corner, left - corner, top - corner, all_ - left - top + corner])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf value per cell) of the best tree with one cut per feature of a pair."""
    qg, qh, qn = _quarters(g), _quarters(h), _quarters(n)
    if not qg[0].size:
        return 0.0, np.zeros_like(g)
    gain = _gain(qg, qh).sum(0) - _gain(g.sum(), h.sum())
    gain = np.where(((qn >= LEAST_ROWS) | (qn == 0)).all(0), gain, -np.inf)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not np.isfinite(gain[i, j]):
        return 0.0, np.zeros_like(g)
    leaf = (qg / (qh + SMOOTH))[:, i, j].reshape(2, 2)
    return float(gain[i, j]), leaf[np.ix_((np.arange(g.shape[0]) > i).astype(int), (np.arange(g.shape[1]) > j).astype(int))]


class _Boosting:
    """Rounds over tables until the loss on the rows kept apart stops falling."""

    def __init__(self, y: np.ndarray, apart: np.ndarray, intercept: float):
        self.y, self.apart = y, apart
        self.total = np.full(len(y), intercept)

    def loss(self) -> float:
        z, y = self.total[self.apart], self.y[self.apart]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def slopes(self, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = _sigmoid(self.total)
        g, h = np.where(self.apart, 0.0, self.y - p), np.where(self.apart, 0.0, p * (1 - p))
        count = lambda w: np.bincount(cell, weights=w, minlength=cells)
        return count(g), count(h), count((~self.apart).astype(float))

    def run(self, cells: list[np.ndarray], shapes: list[tuple[int, ...]], step) -> list[np.ndarray]:
        tables = [np.zeros(s) for s in shapes]
        best, best_loss, since = [t.copy() for t in tables], self.loss(), 0
        for _ in range(ROUNDS):
            for t, (cell, shape) in enumerate(zip(cells, shapes, strict=True)):
                add = RATE * step(*(v.reshape(shape) for v in self.slopes(cell, int(np.prod(shape)))))
                tables[t] += add
                self.total += add.ravel()[cell]
            if (loss := self.loss()) < best_loss - 1e-7:
                best, best_loss, since = [t.copy() for t in tables], loss, 0
            elif (since := since + 1) >= PATIENCE:
                break
        for cell, kept, last in zip(cells, best, tables, strict=True):
            self.total += (kept - last).ravel()[cell]
        return best


def fit_model(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> AdditiveModel:
    """Main effects first, then the pairs that explain most of what is left. Every seventh row decides when to stop."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges, model.pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    fine, coarse = _bins(x, model.edges), _bins(x, model.pair_edges)
    boost = _Boosting(y, np.arange(len(y)) % 7 == 3, model.intercept)
    width = [len(e) + 2 for e in model.edges]
    model.tables = boost.run(list(fine.T), [(w,) for w in width], _tree)
    width = [len(e) + 2 for e in model.pair_edges]
    gains = []
    for a in range(x.shape[1]):
        for b in range(a):
            shape = (width[b], width[a])
            g, h, n = (v.reshape(shape) for v in boost.slopes(coarse[:, b] * width[a] + coarse[:, a], width[a] * width[b]))
            gains.append((_pair_tree(g, h, n)[0], (b, a)))
    chosen = [p for gain, p in sorted(gains, key=lambda v: (-v[0], v[1]))[:pairs] if gain > 0]
    tables = boost.run([coarse[:, a] * width[b] + coarse[:, b] for a, b in chosen], [(width[a], width[b]) for a, b in chosen],
                       lambda g, h, n: _pair_tree(g, h, n)[1])
    model.pairs = dict(zip(chosen, tables, strict=True))
    return model


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Model from the features (``measured``) of the labelled ids, of at most ``max_rows`` rows."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("_lo"), F.max(label_col).alias("y")).where("_lo = y").drop("_lo")
    rows = features.join(known, "id").withColumn("_u", uniform_of(F.concat(F.lit("fit:"), F.col("id").cast("string"))))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.col("_u") < max_rows / n).limit(max_rows)
    table = rows.select("_u", "y", "x").toPandas().sort_values("_u", kind="stable")
    x = np.array(table["x"].tolist(), float).reshape(len(table), len(FEATURES))
    return fit_model(x, table["y"].to_numpy(float))


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """(id, score, predicted) per row of features."""
    shared = features.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    kind = features.schema["id"].dataType.simpleString()

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            x = cols["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = shared.value.score(x)
            yield {"id": cols["id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_rows(features.select("id", "x"), f"id {kind}, score double, predicted int", work)


def measured_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured``, written once: learning and scoring read numbers instead of texts."""
    return materialize(measured(docs, id_col, text_col), "measured")
