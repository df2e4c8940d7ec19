"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on the driver to a bounded sample of labelled documents (``TRAIN_ROWS``, those of lowest digest)
and flattened into node arrays, which every task scores in numpy, all trees and rows of a batch at a time.  Monotonic
constraints make the score fall, or stay, as the share of symbols, repeated lines, repeated windows, capitals, bars or
exclamation marks grows.  Texts are read once, whole, and no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import filtered

#: Labelled documents that the trees are fitted to, at most.
TRAIN_ROWS = 20_000
#: Documents with at least this score are kept, if the base rule lets them.
KEEP = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and the direction in which the score may move with it.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols": -1,
    "dup_lines": -1,
    "repeats": -1,
    "capitals": -1,
    "digits": 0,
    "bars": -1,
    "exclamations": -1,
    "stops": 0,
    "lines": 0,
    "distinct": 0,
}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def statistics(raw: bytes | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """Base counts and features of a text in UTF-8; a null text is empty."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(byte[128:192].sum())
    spaces = int(byte[_SPACES].sum())
    symbols = int(byte[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = [index.setdefault(w, len(index)) for w in words]
    repeated = repeated_words(np.array(ids, np.int64), len(index))
    base = (n, points - spaces, symbols, dup, repeated)
    per = max(n, 1)
    capitals = int(byte[65:91].sum())
    letters = capitals + int(byte[97:123].sum()) + int(byte[192:].sum())
    return base, [
        float(np.log1p(n)),
        (points - spaces) / per,
        symbols / per,
        dup / max(len(lines), 1),
        repeated / per,
        capitals / max(letters, 1),
        int(byte[48:58].sum()) / per,
        int(byte[124]) / per,
        int(byte[33]) / per,
        int(byte[46] + byte[44]) / per,
        len(lines) / per,
        len(index) / per,
    ]


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more; ids number the distinct words."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # three ids would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] = hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of features."""
        out = np.empty(len(x))
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                below = np.take_along_axis(part, self.feature[node], 1) <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            out[at : at + 8192] = 1 / (1 + np.exp(-(self.bias + self.value[node].sum(1))))
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 1.0
) -> Trees:
    """Newton boosting of the logistic loss on binned features.

    A split on a constrained feature must order its children's values by the direction, and their middle bounds all
    values further down, which makes the whole sum monotonic.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if n else np.empty((0, m), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    raw = np.full(n, bias)

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(feature) - 1)
        right.append(len(feature) - 1)
        value.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        weight = lambda a, b: np.clip(-a / (b + ridge), low, high)
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
        own = weight(total_g, total_h)
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                b = binned[rows, j]
                lg, lh = np.bincount(b, g[rows], k).cumsum()[:-1], np.bincount(b, h[rows], k).cumsum()[:-1]
                count = np.bincount(b, minlength=k).cumsum()[:-1]
                wl, wr = weight(lg, lh), weight(total_g - lg, total_h - lh)
                gain = gain_of(lg, lh, wl) + gain_of(total_g - lg, total_h - lh, wr) - gain_of(total_g, total_h, own)
                gain[(count < least) | (len(rows) - count < least) | (directions[j] * (wr - wl) < 0)] = -np.inf
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at, float(wl[at]), float(wr[at]))
        if best[1] < 0:
            return leaf(rate * float(own))
        _, j, at, wl, wr = best
        middle = (wl + wr) / 2
        below = binned[rows, j] <= at
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[directions[j]]
        node = leaf(0.0)
        feature[node], threshold[node] = j, float(edges[j][at])
        left[node] = grow(rows[below], g, h, level + 1, *bounds[:2])
        right[node] = grow(rows[~below], g, h, level + 1, *bounds[2:])
        return node

    def arrays() -> Trees:
        return Trees(np.array(feature, np.intp), np.array(threshold, float), np.array(left, np.intp), np.array(right, np.intp), np.array(value, float), np.array(roots, np.intp), depth, bias)

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
        node = np.full(n, roots[-1])
        now = arrays()
        for _ in range(depth):
            node = np.where(x[np.arange(n), now.feature[node]] <= now.threshold[node], now.left[node], now.right[node])
        raw = raw + now.value[node]
    return arrays()


def label_sample(labels: DataFrame, column: str, rows: int, where=None) -> DataFrame:
    """At most ``rows`` labelled ids, those of lowest digest: the same at every run, a top-k without a full sort.  An id with
    different labels has the greatest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if where is not None:
        known = known.filter(where)
    one = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("__label"))
    return one.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py())[1] for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, where=None) -> Trees:
    """Fits to the labelled sample, of an id with several texts to the one of least features; ``where``: labels to learn from.
    Without labelled documents the trees are none and every score is a half or more."""
    sample = label_sample(labels, "quality", rows, where)
    known = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body")).join(F.broadcast(sample), "doc_id")
    seen = known.select("doc_id", F.col("__label").alias("y"), "body").mapInArrow(_features, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")
    got = seen.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toArrow()  # a row for each id of the sample
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got.column("y").to_numpy()))  # rows come in any order; sums shall not differ
    return fit_trees(x[order], got.column("y").to_numpy()[order].astype(float), list(FEATURES.values()))


def assess(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, score, kept of every row.

    A null or empty text has no words and fails the base rule.  Repeated rows and null ids are judged row by row.
    Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [statistics(t.as_py()) for t in batch.column(1)]
            score, failed = judge(trees, seen)
            base = [pa.array([b[i] for b, _ in seen], pa.int64()) for i in range(len(BASE))]
            arrays = [batch.column(0), *base, pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *BASE, "base_failed", "score", "kept"])

    id_type = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{b} long' for b in BASE)}, base_failed boolean, score double, kept boolean")


def judge(trees: Trees, seen: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([f for _, f in seen], float).reshape(-1, len(FEATURES))
    return trees.score(x), np.array([base_failed(b) for b, _ in seen], bool)


def keep_good(df: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, failed = judge(trees, [statistics(t.as_py()) for t in batch.column(at).cast(pa.binary())])
            yield batch.filter(pa.array(~failed & (score >= KEEP)))

    return filtered(df, run)
