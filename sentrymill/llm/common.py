"""What the operators share: session settings, stored intermediate tables, byte-level word hashing, grouped batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.session import checkpoint_folder, tune

#: One character that separates words: space and \x09-\x0D, the set that bytes.split() and bytes.strip() use.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the library, and small Arrow batches, as texts may be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back: nothing above is computed again."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns that no result column takes the place of; names are compared as Spark does, without case."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow for columns of any name; the function sees them by place."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(function, schema)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(total: int, most: int) -> int:
    """How many parts of about ``most`` rows hold ``total`` rows."""
    return max(1, math.ceil(total / most))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, A-Z lower-cased, and the number of words per text.

    A word's hash is a polynomial over its bytes, taken as a difference of running sums (the base is odd, so
    its powers can be undone modulo 2 ** 64), then finalised with the word's length.  The work is a few numpy passes over
    blocks of bytes, whatever the texts' lengths.
    """
    counts, hashes, at = np.zeros(len(texts), np.int64), [], 0
    undo = pow(_BASE, -1, 1 << 64)
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 22):
            size += len(texts[end]) + 1
            end += 1
        b = np.frombuffer(b" " + b" ".join(texts[at:end]) + b" ", np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            run = np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * _powers(len(b), _BASE), dtype=np.uint64)
            h = (run[stop - 1] - run[start - 1]) * _powers(len(b), undo)[start]
            hashes.append(mixed(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts[at:end] = np.diff(np.searchsorted(start, ends, side="right"), prepend=0)
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, regrouped so that no value of it is split over two tables.

    The caller bounds the rows of one value (it splits larger groups before); so memory is bounded by that and ``rows``.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        last = keys[-1].as_py()
        values = keys.to_numpy()
        cut = int(np.searchsorted(values, last))  # keys are sorted
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def bounds(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def pairs_within(starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j inside each run, in chunks of about ``most`` pairs."""
    ends = np.repeat(starts[1:], np.diff(starts))
    rows = np.arange(len(ends))
    left = ends - rows - 1
    total = np.cumsum(left)
    at = 0
    while at < len(rows):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        n = left[at:stop]
        i = np.repeat(rows[at:stop], n)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            deep = new[new]
            if np.array_equal(deep, new):
                break
            new = deep
        if np.array_equal(new, label):
            return label
        label = new


def column(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
