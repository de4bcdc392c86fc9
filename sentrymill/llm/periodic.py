"""Periodic runs of words, by seeds on diagonals.

A run of period q is a stretch of words whose words q apart are equal, at least ``least`` words and twice its period long, that no
neighbour extends and that has no smaller period.  Words q apart that are equal make a stretch on the diagonal of lag q;
a run's stretch holds max(least - q, q) places or more.

1. Seeds: k-grams are named exactly (equal name, equal words) and indexed by name.  k is taken from the overlap that the lags
   guarantee: half of ``least`` for lags below ``least``, at each place; for lags from L to 2L, a stretch holds L places, so one of
   the k-grams at the multiples of k = L / 2 lies within it.  Names of 2k-grams come from pairs of names of k-grams, and only grams that
   occur twice go on.
2. Occurrence pairs: each such gram meets the occurrences of its name that lie L to 2L further on in the same document.
3. Extension: by lag, seeds that follow each other without a gap are one stretch, so a place that a lag has covered is not
   extended again; a stretch grows at both ends by the shorter grams' names, longest first, then by words.
4. Of stretches over the same words the one with the smallest lag is the run; the others are its multiples.

A gram meets at most 2L = 4k places and there are n / k grams, so a text of n words has no more than some n log n pairs, whatever it
repeats.  Documents are worked on together in groups of ``WORDS`` words (a longer document alone), and lags are split
where their pairs would be more than ``PAIRS``.

Defined cases: null and empty text have no words, no runs and an empty collapsed text; words keep their case; rows that repeat are
each answered; result columns replace columns of their name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, mixed, others, raw, ready

LEAST = 12
#: Words that are worked on together, and pairs in memory at once; they change no result.
WORDS, PAIRS = 400_000, 2_000_000
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, equal for equal pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _twice(at: np.ndarray, name: np.ndarray, size: int) -> np.ndarray:
    """The names by place; -1 where a name occurs once."""
    out = np.full(size, -1, np.int64)
    keep = np.bincount(name)[name] > 1 if len(name) else np.zeros(0, bool)
    out[at[keep]] = name[keep]
    return out


def named(words: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-grams that occur twice, by place.  Hashes only sort out grams that are alone."""
    size = max(0, len(words) - k + 1)
    h = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mixed(h * np.uint64(0x100000001B3) + words[i:i + size].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    shared = np.zeros(size, bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)
    name = words[at]
    for i in range(1, k):
        name = _paired(name, words[at + i])
    return _twice(at, _paired(name, np.zeros_like(name)), size)


def doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of 2k-grams from those of k-grams."""
    size = max(0, len(names) - k)
    at = np.flatnonzero((names[:size] >= 0) & (names[k:] >= 0))
    return _twice(at, _paired(names[at], names[at + k]), size)


def seeds(names: np.ndarray, step: int, low: int, high: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lag, place) of the grams at multiples of ``step`` whose name occurs again low to high - 1 places on.

    Each lag comes whole in one piece.
    """
    size = len(names) + 1
    at = np.flatnonzero(names >= 0)
    index = np.sort(names[at] * size + at)
    anchors = at[at % step == 0]
    todo = [(low, high)]
    while todo:
        low, high = todo.pop()
        base = names[anchors] * size
        first = np.searchsorted(index, base + np.minimum(anchors + low, size - 1))
        n = np.searchsorted(index, base + np.minimum(anchors + high, size - 1)) - first
        total = int(n.sum())
        if total > most and high - low > 1:
            todo += [((low + high) // 2, high), (low, (low + high) // 2)]
        elif total:
            place = np.repeat(anchors, n)
            hit = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
            yield index[hit] % size - place, place


def _grown(names: np.ndarray, start: np.ndarray, end: np.ndarray, lag: np.ndarray, k: int) -> None:
    """Takes a k-gram in at either end of each stretch where it equals the one ``lag`` places on."""
    last = len(names) - 1
    here, there = names[np.clip(end, 0, last)], names[np.clip(end + lag, 0, last)]
    end += np.where((end + lag <= last) & (here >= 0) & (here == there), k, 0)
    here, there = names[np.clip(start - k, 0, last)], names[np.clip(start - k + lag, 0, last)]
    start -= np.where((start >= k) & (start - k + lag <= last) & (here >= 0) & (here == there), k, 0)


def runs(words: np.ndarray, least: int = LEAST, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period.

    ``words`` are numbers, those of different documents different, so that no gram occurs twice across documents.
    """
    if least < 4 or least % 2:
        raise ValueError("the least length of a run is an even number from 4 on")
    k, low, high, step = least // 2, 1, least, 1
    levels = [named(words, k)]
    found = [np.zeros((3, 0), np.int64)]
    while (levels[-1] >= 0).any():
        for lag, place in seeds(levels[-1], step, low, high, most):
            order = np.lexsort((place, lag))
            lag, place = lag[order], place[order]
            new = np.ones(len(lag), bool)
            new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + step)
            at = np.flatnonzero(new)
            start, lag = place[at], lag[at]
            end = place[np.append(at[1:], len(place)) - 1] + k
            if step > 1:
                for level in range(len(levels) - 2, -1, -1):
                    _grown(levels[level], start, end, lag, least // 2 << level)
                for _ in range(least // 2 - 1):
                    _grown(words, start, end, lag, 1)
            whole = end - start >= np.maximum(least - lag, lag)
            found.append(np.stack([start, end + lag, lag])[:, whole])
        if step > 1:  # lags below ``least`` and those up to twice as long share the first level
            levels.append(doubled(levels[-1], k))
            k *= 2
        low, high, step = high, 2 * high, k
    start, end, lag = np.concatenate(found, axis=1)
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, lag = start[own], end[own], lag[own]
    order = np.lexsort((lag, start))
    return start[order], (end - start)[order], lag[order]


def _groups(texts: list[bytes], most: int) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.split()
        if group and size + len(words) > most:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _of_group(group: list[list[bytes]], least: int) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Runs per document, their (start, length, period), and the collapsed texts."""
    sizes = [len(words) for words in group]
    numbers: list[np.ndarray] = []
    before = 0
    for words in group:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + before)
        before += len(known)
    start, length, period = runs(np.concatenate(numbers), least)
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, start, side="right")
    change = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    collapsed = []
    for words, end in zip(group, ends.tolist(), strict=True):
        kept = stays[end - len(words):end]
        collapsed.append(b" ".join(words if kept.all() else compress(words, kept.tolist())))
    return np.bincount(of, minlength=len(group)), [start - (ends - sizes)[of], length, period], collapsed


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """All rows and columns; runs (start, length, period: by start, then period), n_words, and collapsed (the words that no run holds
    after its first period, joined by one blank)."""
    ready(docs.sparkSession)
    names = others(docs, "runs", "n_words", "collapsed")
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            counts, parts, collapsed, sizes = [], [], [], []
            for group in _groups(raw(batch.column(len(names))), WORDS):
                n, found, texts = _of_group(group, least)
                counts.append(n)
                parts.append(found)
                collapsed += texts
                sizes += [len(words) for words in group]
            ends = pa.array(np.cumsum(np.concatenate([[0], *counts])), pa.int32())
            values = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)])) for i in range(3)]
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, names=RUN.fieldNames()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                [f.name for f in schema])

    return map_batches(docs.select(*[column(c) for c in names], column(text_col).cast("string").alias("_text")), run, schema)


def longest(found) -> F.Column:
    """The longest of an array of runs; of equal ones that which starts first, then that of the smallest period."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                             (-r["period"]).alias("period"))))
    return F.when(F.size(found) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"),
                                              (-best["period"]).alias("period")))
