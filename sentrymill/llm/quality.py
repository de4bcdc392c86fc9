"""Quality rules: exact text statistics, and gradient-boosted trees over them.

Statistics of a text (words are split at blanks): code points in words, characters of ``SYMBOLS``, lines with a word that equal an
earlier line, and words in 8-word windows that occur twice or more in the text.  Base rules reject a text outright; a boosted model
judges the rest by ratios of the statistics.

The trees are grown in numpy, on histograms of at most ``MOST_ROWS`` labelled documents per class (a documented bound), with
logistic loss.  Features marked in ``FEATURES`` may only lower (-1) the score as they grow: a split that would break this
is not taken, and the bounds of both sides are kept below it.  For scoring, all trees are flattened into node arrays (feature,
threshold, left, right, value), and all rows walk one tree level per numpy step.

Defined cases: null and empty text have no words and fail the base rules; a null doc_id is scored, never trained on; without
labelled rows of both classes the base rules decide alone; result columns replace columns of their name; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, others, raw, ready

SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
MOST_ROWS = 5_000
#: Feature and the direction that the score may take as it grows (0: any).
FEATURES = {"words": 0, "word_length": 0, "symbols_per_word": -1, "lines_repeated": -1, "words_repeated": -1, "upper": -1,
            "digits": 0, "punctuation": -1, "words_per_line": 0, "distinct_words": 0, "line_ends": 0}
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SMOOTH = 60, 3, 0.15, 64, 20, 5.0
CUT = 0.5

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"]] = 3


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words)) - _continued(text)
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated, repeated_words(words)


def _continued(text: bytes) -> int:
    """Bytes that continue a code point."""
    if text.isascii():
        return 0
    b = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((b & 0xC0) == 0x80))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of this many words that the text holds twice or more, the first one included."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # windows of 1, 2, 4 and 8 words as dense numbers: equal numbers are equal windows
    step = 1
    while step < window:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def features(text: bytes, stats: tuple[int, int, int, int, int]) -> list[float]:
    n, chars, symbols, dup, rep = stats
    lines = text.count(b"\n") + 1
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4) if text else np.zeros(4)
    size = max(1, chars)
    ends = sum(line.rstrip().endswith((b".", b"!", b"?")) for line in text.split(b"\n"))
    return [np.log1p(n), chars / max(1, n), symbols / max(1, n), dup / lines, rep / max(1, n), kinds[1] / size, kinds[2] / size,
            kinds[3] / size, n / lines, len(set(text.split())) / max(1, n), ends / lines]


@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf has feature -1 and points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                low = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))


def boost(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES) -> Trees:
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    mean = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
    base = float(np.log(mean / (1 - mean)))
    roots: list[int] = []
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros(0, np.int64), *(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, float)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    total = np.full(len(y), base)

    def leaf(value: float) -> int:
        nodes.append([-1, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        all_g, all_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(all_g / (all_h + SMOOTH), low, high))
        best = None
        if depth and len(rows) >= 2 * LEAST_LEAF:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b, size = bins[rows, f], len(e) + 1
                n = np.cumsum(np.bincount(b, minlength=size))[:-1]
                lg, lh = (np.cumsum(np.bincount(b, v[rows], size))[:-1] for v in (g, h))
                rg, rh = all_g - lg, all_h - lh
                lv, rv = (np.clip(a / (c + SMOOTH), low, high) for a, c in ((lg, lh), (rg, rh)))
                gain = lg * lv - (lh + SMOOTH) * lv ** 2 / 2 + rg * rv - (rh + SMOOTH) * rv ** 2 / 2
                gain -= all_g * value - (all_h + SMOOTH) * value ** 2 / 2
                ok = (n >= LEAST_LEAF) & (len(rows) - n >= LEAST_LEAF)
                if directions[f]:
                    ok &= (rv - lv) * directions[f] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
        if best is None:
            return leaf(RATE * value)
        _, f, k, lv, rv = best
        at = len(nodes)
        nodes.append([f, float(edges[f][k]), 0, 0, 0.0])
        bounds = [(low, high), (low, high)]
        if directions[f]:  # neither side may pass the middle in any later split
            middle = (lv + rv) / 2
            bounds = [(low, middle), (middle, high)] if directions[f] > 0 else [(middle, high), (low, middle)]
        is_low = bins[rows, f] <= k
        nodes[at][2] = grow(rows[is_low], g, h, depth - 1, *bounds[0])
        nodes[at][3] = grow(rows[~is_low], g, h, depth - 1, *bounds[1])
        return at

    model = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH, -np.inf, np.inf))
        flat = list(zip(*nodes, strict=True))
        model = Trees(base, np.array(roots), np.array(flat[0], np.int64), np.array(flat[1]), np.array(flat[2], np.int64),
                      np.array(flat[3], np.int64), np.array(flat[4]))
        one = Trees(0.0, model.roots[-1:], model.feature, model.threshold, model.left, model.right, model.value)
        total = total + one.raw(x)
    return model


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
           most: int = MOST_ROWS) -> Trees:
    """Learns from at most ``most`` labelled documents of each class, the first by a hash of the id."""
    ready(docs.sparkSession)
    key, label = column(id_col).cast("long").alias("_id"), column(label_col).cast("int").alias("_label")
    pool = (labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1)).select(key, label)
            .groupBy("_id").agg(F.min("_label").alias("_label")))
    counts = {r["_label"]: r["count"] for r in pool.groupBy("_label").count().collect()}
    parts = [pool.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most) for v in (0, 1)]

    def measured(batches):
        for batch in batches:
            rows = [features(t, statistics(t)) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["_label", "x"])

    rows = (docs.select(key, column(text_col).cast("string").alias("_text"))
            .join(F.broadcast(parts[0].unionByName(parts[1])), "_id")  # at most 2 * most rows of two numbers
            .dropDuplicates(["_id"]).orderBy("_id").select("_label", "_text").mapInArrow(measured, "_label int, x array<double>").toArrow())
    x = np.array(rows.column(1).to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    y = np.asarray(rows.column(0)).astype(float)
    model = boost(x, y, list(FEATURES.values()))
    if len(counts) == 2 and 0 < y.mean() < 1:  # the bound may take more of one class than of the other
        share = counts[1] / sum(counts.values())
        model.base += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return model


_RESULT = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
           ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("quality_score", T.DoubleType()), ("kept", T.BooleanType())]


def judged(docs: DataFrame, model: Trees, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """All rows and columns, with the statistics, base_failed, quality_score (0 to 1) and kept."""
    ready(docs.sparkSession)
    names = others(docs, *[n for n, _ in _RESULT])
    place = names.index(text_col)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(n, t) for n, t in _RESULT])

    def run(batches):
        for batch in batches:
            texts = raw(batch.column(place))
            stats = [statistics(t) for t in texts]
            failed = np.array([base_failed(s[0], s[4]) for s in stats], bool)
            x = np.array([features(t, s) for t, s in zip(texts, stats, strict=True)], float).reshape(len(texts), len(FEATURES))
            score = model.score(x)
            values = [*np.array(stats, np.int64).reshape(len(texts), 5).T, failed, score, ~failed & (score >= cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], [f.name for f in schema])

    return map_batches(docs.select(*[column(c) for c in names]), run, schema)
