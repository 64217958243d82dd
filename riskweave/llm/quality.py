"""Quality classifier: a generalised additive model with pairwise interactions (operator 8).

Every feature of a text is cut into quantile bins. Shallow regression trees over one feature's bins are
boosted in turn, feature after feature, round after round, each adding a small step to that feature's
lookup table; then trees with one cut on each axis are boosted the same way on the few feature pairs
that explain most of what is left. A text's score is the logistic function of an intercept plus one
table entry for each feature and pair: bin numbers, gathers and additions over whole batches.

The fit uses at most ``FIT_ROWS`` labelled rows outside the held-out ones; features reach the driver for
those rows only. Every row is scored, on its whole text.

Defined results: a null or empty text has the features of no words and is scored like any other; without
usable labels, or with one class only, every score is that class's smoothed share (0.5 without labels).
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import ship

from .common import kept, release, tidy
from .learn import held_out, labelled_sample, sigmoid

#: Bound of the labelled rows that the model is fitted on.
FIT_ROWS = 12_000
FEATURES = ["log_words", "word_bytes", "upper", "digit", "mark", "symbol", "beyond_ascii", "short_words", "long_words", "distinct_words", "distinct_pairs", "repeats", "line_words", "distinct_lines", "bare_marks"]

_CLASS = np.full(256, 6, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 mark, 5 symbol, 6 beyond ASCII
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in ".,;:!?'\"-()" else 5


def features(text: str) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; all finite."""
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    n, size = len(w), max(1, len(raw))
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / size
    if not n:
        return [0.0, 0.0, *by[[1, 2, 4, 5, 6]].tolist(), *[0.0] * 8]
    long = np.fromiter(map(len, w), np.int64, n)
    lines = raw.split(b"\n")
    pairs = max(1, n - 1)
    return [
        float(np.log1p(n)), float(long.mean()), *by[[1, 2, 4, 5, 6]].tolist(), float((long <= 3).mean()), float((long > 14).mean()), len(set(w)) / n,
        len(set(zip(w, w[1:]))) / pairs, sum(map(eq, w, w[1:])) / pairs, float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), sum(map(w.count, (b"|", b"-", b"*", b"#"))) / n,
    ]


def matrix(strings: list[str]) -> np.ndarray:
    return np.array([features(s) for s in strings], float).reshape(len(strings), len(FEATURES))


@dataclass
class Additive:
    """Cut points and lookup tables; ``score`` needs nothing else."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, i], b[:, j]]
        return sigmoid(out)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Best place to cut a row of bins in two, by gain; place 0 where no cut leaves enough weight on both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -1.0)
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k] - g.sum() ** 2 / (h.sum() + ridge)), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree with up to four leaves."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        spans = [s for a, b in spans for k in [_cut(g[a:b], h[a:b], ridge, least)[1]] for s in ([(a, a + k), (a + k, b)] if k else [(a, b)])]
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a table of bins."""
    c = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[1:-1, 1:-1]
    left = lambda t: t.sum(1).cumsum()[:-1, None]
    top = lambda t: t.sum(0).cumsum()[None, :-1]
    parts = [[c(t), left(t) - c(t), top(t) - c(t), t.sum() - left(t) - top(t) + c(t)] for t in (g, h)]
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(a**2 / (b + ridge) for a, b in zip(*parts, strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [a[i, j] / (b[i, j] + ridge) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, ridge: float = 2.0, least: float = 3.0) -> Additive:
    """Fits the tables by cyclic boosting of the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, f = model.bins(x), np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = sigmoid(f)
            step = rate * _tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), ridge, least)
            t += step
            f += step[b[:, j]]
    p = sigmoid(f)
    sums = lambda i, j, v: np.bincount(b[:, i] * len(model.tables[j]) + b[:, j], v, len(model.tables[i]) * len(model.tables[j])).reshape(len(model.tables[i]), -1)
    gains = sorted(((_quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[0], (i, j)) for i, j in combinations(range(len(model.tables)), 2)), reverse=True)
    model.pairs = [ij for gain, ij in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = sigmoid(f)
            step = rate * _quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[1]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """Fits on a bounded labelled sample; features are computed on the executors."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", fit_rows).mapInArrow(tidy("quality", run), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = train(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                score = model.score(matrix([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy("quality", run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, whole, whose score reaches the threshold. Row by row: rows without doc_id and repeated rows are judged too."""
    import pandas as pd

    model = train(docs, labels, fit_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kept("quality", "", list)
        out = pd.Series(model.score(matrix([t or "" for t in texts])))
        release()
        return out

    return docs.where(score("text") >= threshold)
