"""Embedding near-dedup by cross-polytope hashing.

A vector is flipped in sign at random and put through the fast Hadamard transform, three times over; the largest
coordinate and its sign are one of 2d vertices of the cross-polytope.  ``order`` such vertices make a bucket; every
vector also goes to the buckets of its ``PROBES`` next best vertices.  The order grows with the number of vectors, so that unrelated vectors
seldom meet; the number of tables follows from the target recall and the share of pairs at the threshold
that meet in one table, which is measured on pairs drawn for it.

Vectors that meet are compared exactly, in double precision, and the linked ones tied to stars; components of these are then
compared within, part by part, to count links.  Equal vectors are compared once.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do vectors of
different length; a null vec_id too, with null component; rows of one vec_id are one vector, that with the smallest hash; result
columns replace columns of their name; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import column, mixed, ready, stored
from sentrymill.llm.groups import cells, compared, components, with_groups

COSINE, RECALL, PROBES = 0.95, 0.9999, 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def keys_of(x: np.ndarray, tables: int, order: int, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket numbers, rows by tables by (own bucket and probes)."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        vertices, losses = [], []
        for _ in range(order):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d)) / math.sqrt(d)
            some = min(3, d)
            best = np.argpartition(-np.abs(y), some - 1, axis=1)[:, :some]
            size = np.take_along_axis(np.abs(y), best, 1)
            rank = np.argsort(-size, axis=1, kind="stable")
            best, size = np.take_along_axis(best, rank, 1), np.take_along_axis(size, rank, 1)
            sign = np.take_along_axis(y, best, 1) < 0
            vertices.append(2 * best + sign)
            losses.append(size[:, :1] - size[:, 1:])
        own = np.stack([v[:, 0] for v in vertices], 1)
        # a probe changes one vertex for its second or third best, whichever loses least
        loss = np.concatenate(losses, 1)
        swap = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        for p in range(1 + probes):
            codes = own.copy()
            if p and p - 1 < swap.shape[1]:
                which, nth = swap[:, p - 1] // (some - 1), 1 + swap[:, p - 1] % (some - 1)
                for k in range(order):
                    at = which == k
                    codes[at, k] = vertices[k][at, nth[at]]
            key = np.full(n, (t + 1) * 1_000_003 + dim, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(order):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].astype(np.uint64))
            out[:, t, p] = key
    return out


def plan(n: int, dim: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, trials: int = 2_000) -> tuple[int, int]:
    """(tables, order) for n vectors; the chance to meet is measured on drawn pairs of exactly this cosine."""
    d = 1 << max(1, (dim - 1).bit_length())
    order = max(1, math.ceil(math.log(max(2, n * (1 + probes))) / math.log(2 * d)))
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, trials, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b / np.where(norm == 0, 1, norm)
    ka, kb = (keys_of(v, 1, order, probes, seed=5)[:, 0] for v in (a, b))
    meet = float((ka[:, :, None] == kb[:, None, :]).any((1, 2)).mean())
    meet = min(max(meet, 1 / trials), 0.999)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet))), order


def usable(batch_column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Rows whose vector can link, and the vectors."""
    rows, vectors = [], []
    for i, v in enumerate(batch_column):
        if v.is_valid and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                vectors.append(x + 0.0)
    return rows, vectors


def _linked(cosine: float):
    def same(t: pa.Table):
        lengths = np.array([len(x) for x in t.column("vector").to_pylist()])
        flat = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64)
        x = np.zeros((len(lengths), lengths.max() // 8))
        x[np.arange(x.shape[1]) < (lengths // 8)[:, None]] = flat
        x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return lambda i, j: (np.einsum("ij,ij->i", x[i], x[j]) >= cosine) & (lengths[i] == lengths[j])

    return same


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 recall: float = RECALL, block: int = 1_000) -> DataFrame:
    """All rows and columns; class_id, n_links (other vectors with this cosine or more), component_id, kept."""
    ready(df.sparkSession)

    def read(batches):
        for batch in batches:
            rows, vectors = usable(batch.column(1))
            data = [x.tobytes() for x in vectors]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in data), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(data, pa.binary())],
                ["key", "hi", "lo", "vector"])

    rows = (df.where(column(id_col).isNotNull()).select(column(id_col).cast("long").alias("key"), column(vector_col).alias("v"))
            .mapInArrow(read, "key long, hi long, lo long, vector binary"))
    every = stored(rows.groupBy("key").agg(F.min(F.struct("hi", "lo", "vector")).alias("_")).select("key", "_.*"))
    classes = stored(every.groupBy("hi", "lo").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies")))
    one = stored(every.join(classes.select(F.col("id").alias("key"), "id", "copies"), "key").select("id", "copies", "vector"))
    n, size = one.agg(F.count(F.lit(1)), F.max(F.length("vector"))).first()
    tables, order = plan(n, (size or 16) // 8, cosine, recall)

    def hashed(batches):
        for batch in batches:
            ids, data = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            lengths = np.array([len(x) for x in data])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), -1)
                x = x / np.abs(x).max(1, keepdims=True)
                keys = keys_of(x, tables, order).reshape(len(at), -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[at], keys.shape[1]))],
                                                 ["node", "id"])

    met = one.select("id", "vector").mapInArrow(hashed, "node long, id long").distinct()
    near = cells(stored(met), "node", block).join(one, "id")
    found = stored(components(compared(near, _linked(cosine))).withColumnRenamed("node", "id"))
    members = cells(found.select("id", "component"), "component", block).join(one, "id")
    links = stored(compared(members, _linked(cosine), "copies"))
    return with_groups(df, id_col, every, classes, links, ("class_id", "n_links", "component_id", "kept"))
