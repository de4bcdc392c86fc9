"""Toxicity: subword-bag embeddings, averaged over runs of words, into a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 7 code points, with word edges) and of itself; a run of
about ``RUN`` words is the mean of its words; a linear softmax gives its class.  Embeddings and softmax
are trained jointly with Adam in numpy, on the driver, on at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents (a documented
bound; classes are weighted back to their shares among all labelled rows).  The score of a document is that of its
worst run, so a few words in a long text are not averaged away.  Unseen misspellings share n-grams with known words.

For scoring the model folds into one number per n-gram: averaging and softmax input are linear.  Every task keeps a
cache of word values, emptied when it reaches ``CACHE`` words; it changes no result.

Defined cases: null or empty text is a run without words and gets the bias' score; a null doc_id is scored and never trained
on; repeated rows get equal scores; without labelled rows of both classes every score is the share of label 1 (0 if
there are none); result columns replace columns of their name; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, others, raw, ready

RUN, SHORTEST = 128, 16
MOST_TOXIC, MOST_CLEAN = 1_000, 3_000
THRESHOLD = 0.3
CACHE = 400_000
DIMS, STEPS, RATE, DECAY, MOST_GRAMS, APART = 4, 140, 0.3, 1e-6, 20_000, 5.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w, *(w[i:i + n] for n in (3, 4, 5, 6, 7) for i in range(len(w) - n + 1) if n < len(w))]


def run_starts(n: int) -> np.ndarray:
    """Starts of runs of nearly equal length, about RUN words each."""
    return np.linspace(0, n, max(1, round(n / RUN)), endpoint=False).astype(np.int64)


@dataclass
class Model:
    """Value of each n-gram, difference of the two classes' inputs; bias; share of label 1."""

    bias: float
    value: dict[str, float] = field(default_factory=dict)

    def word(self, word: bytes) -> float:
        gs = grams(word.decode("utf-8", "replace"))
        return sum(self.value.get(g, 0.0) for g in gs) / len(gs)

    def score(self, texts: list[bytes], cache: dict[bytes, float] | None = None) -> np.ndarray:
        cache = {} if cache is None else cache
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = text.lower().split()
            if not words:
                out[i] = self.bias
                continue
            if len(cache) > CACHE:
                cache.clear()
            for w in set(words).difference(cache):
                cache[w] = self.word(w)
            values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
            starts = run_starts(len(words))
            sizes = np.diff(starts, append=len(words))
            out[i] = self.bias + (np.add.reduceat(values, starts) / np.maximum(sizes, SHORTEST)).max()
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


class _Means:
    """Sparse rows of weights, and products with a dense matrix from either side."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.weight, self.shape = row, col, weight.astype(np.float32), shape

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, self.weight * x[self.col, k], self.shape[0]).astype(float) for k in range(x.shape[1])], 1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.col, self.weight * g[self.row, k], self.shape[1]).astype(float) for k in range(g.shape[1])], 1)


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """``share``: of label 1 among all rows that may be learned from; the sample's classes are weighted back to it."""
    if len(texts) == 0 or labels.min() == labels.max():
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    in_docs: Counter = Counter()
    one: dict[bytes, bytes] = {}  # equal words share one object
    per_doc = [[one.setdefault(w, w) for w in t.lower().split()] for t in texts]
    for words in per_doc:
        in_docs.update(set(words))
    known = {w: i for i, w in enumerate(sorted(w for w, n in in_docs.items() if n >= 3))}
    # n-grams whose share of documents differs between the classes by more than chance; others stay zero vectors, so that
    # wrong labels are not learned by heart
    in_toxic = Counter(w for words, label in zip(per_doc, labels, strict=True) if label for w in set(words))
    seen, seen_toxic = Counter(), Counter()
    for w in known:
        for g in set(grams(w.decode("utf-8", "replace"))):
            seen[g] += in_docs[w]
            if in_toxic[w]:
                seen_toxic[g] += in_toxic[w]
    all_words, toxic_words = sum(in_docs.values()), sum(in_toxic.values())
    rate = toxic_words / all_words
    apart = {g: (seen_toxic[g] - n * rate) / np.sqrt(n * rate * (1 - rate)) for g, n in seen.items() if n >= 3}
    kept = sorted((g for g, z in apart.items() if abs(z) >= APART), key=lambda g: (-abs(apart[g]), g))[:MOST_GRAMS]
    gram = {g: i for i, g in enumerate(kept)}
    row, col, weight = [], [], []
    del seen, seen_toxic, apart
    for w, i in known.items():
        gs = grams(w.decode("utf-8", "replace"))  # made again: all n-grams of all words would not stay in memory
        ids = [gram[g] for g in gs if g in gram]
        row += [i] * len(ids)
        col += ids
        weight += [1 / len(gs)] * len(ids)
    words_of = _Means(np.array(row, np.int32), np.array(col, np.int32), np.array(weight), (len(known), len(gram)))
    del in_docs, in_toxic, row, col, weight

    rng = np.random.default_rng(seed)
    run_row, run_word, run_weight, run_doc = [], [], [], []
    for d, words in enumerate(per_doc):
        n = len(words)
        starts = run_starts(n)
        sizes = np.diff(starts, append=n)
        ids = np.fromiter((known.get(w, -1) for w in words), np.int32, n)
        run = len(run_doc) + np.searchsorted(starts, np.arange(n), side="right") - 1
        run_row.append(run[ids >= 0])
        run_word.append(ids[ids >= 0])
        run_weight.append((1 / np.maximum(sizes, SHORTEST))[run - len(run_doc)][ids >= 0])
        run_doc += [d] * len(starts)
    run_row, run_word, run_weight = (np.concatenate(x) for x in (run_row, run_word, run_weight))
    run_doc = np.array(run_doc)
    y = labels[run_doc].astype(np.float64)
    class_weight = np.where(y == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
    runs = len(run_doc)
    part = rng.permutation(runs) % max(1, runs // 4_000)
    batches = []
    for p in range(part.max() + 1):
        inside = np.flatnonzero(part == p)
        at = np.zeros(runs, np.int64)
        at[inside] = np.arange(len(inside))
        mine = part[run_row] == p
        batches.append((_Means(at[run_row[mine]], run_word[mine], run_weight[mine], (len(inside), len(known))), inside))
    params = [rng.normal(0, 0.05, (len(gram), DIMS)), rng.normal(0, 1, (DIMS, 2)), np.zeros(2)]
    params[2][1] = np.log((share + 1e-3) / (1 - share + 1e-3))
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        vectors = words_of.times(params[0])
        if step == STEPS // 2:
            # only the runs of a toxic document that look toxic by now stand for its label
            seen_as = np.zeros(runs)
            for mean, inside in batches:
                seen_as[inside] = mean.times(vectors) @ (params[1][:, 1] - params[1][:, 0])
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, run_doc, seen_as)
            class_weight = np.where((y == 1) & (seen_as < worst[run_doc] - 1), 0.0, class_weight)
        mean, inside = batches[step % len(batches)]
        target, cost = y[inside], class_weight[inside]
        hidden = mean.times(vectors)
        z = hidden @ params[1] + params[2]
        z = np.exp(z - z.max(1, keepdims=True))
        error = z / z.sum(1, keepdims=True)
        error[:, 0] -= 1 - target
        error[:, 1] -= target
        error *= (cost / len(target))[:, None]
        slopes = [words_of.back(mean.back(error @ params[1].T)), hidden.T @ error, error.sum(0)]
        slopes[0] += DECAY * params[0]
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for p, g, m, v in zip(params, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    direction = params[1][:, 1] - params[1][:, 0]
    values = params[0] @ direction
    return Model(float(params[2][1] - params[2][0]), {g: float(values[i]) for g, i in gram.items()})


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           most: tuple[int, int] = (MOST_TOXIC, MOST_CLEAN)) -> Model:
    """Learns from labelled rows outside ``held_out``; the bounded sample is the first rows by a hash of the id."""
    ready(docs.sparkSession)
    key, label = column(id_col).cast("long").alias("_id"), column(label_col).cast("int").alias("_label")
    pool = (labels.where(column(id_col).isNotNull() & column(label_col).isin(0, 1) & ~held_out(column(id_col)))
            .select(key, label).groupBy("_id").agg(F.max("_label").alias("_label")))
    total = {r["_label"]: r["count"] for r in pool.groupBy("_label").count().collect()}
    if not total:
        return Model(-60.0)
    share = total.get(1, 0) / sum(total.values())
    taken = None
    for value, bound in ((1, most[0]), (0, most[1])):
        some = pool.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(bound)
        taken = some if taken is None else taken.unionByName(some)
    rows = (docs.select(key, column(text_col).cast("string").alias("_text"))
            .join(F.broadcast(taken), "_id")  # at most sum(most) rows of two numbers
            .dropDuplicates(["_id"]).orderBy("_id").select("_text", "_label").toArrow())
    return train(raw(rows.column(0).combine_chunks() if rows.num_rows else pa.array([], pa.string())),
                 np.asarray(rows.column(1)).astype(np.int64), share)


def scored(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with score and predicted."""
    ready(docs.sparkSession)
    names = others(docs, "score", "predicted")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    place = names.index(text_col)

    def run(batches):
        cache: dict[bytes, float] = {}
        for batch in batches:
            score = model.score(raw(batch.column(place)), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             [f.name for f in schema])

    return map_batches(docs.select(*[column(c) for c in names]), run, schema)
