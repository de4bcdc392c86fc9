"""N-gram Jaccard join by chosen paths.

Texts are sets of word 5-grams (words split at blanks, A-Z lower-cased; a text of one to four words is one n-gram; a
text without words has none and links with nothing).  Texts with equal sets are a class and are compared once.

1. Every class gets a sketch of ``TOKENS`` minhash tokens: two sets agree on a token with the probability of
   their similarity.
2. Chosen paths: each run splits all classes on a token position drawn for the run, each large bucket again on a
   position drawn for its path (a quarter of the nodes draw two), until buckets are small or ``DEPTH`` is reached.  Two sets
   stay together along a path while they agree on the chosen tokens.  Runs are repeated as often as the
   target recall asks at the threshold (``runs_for``), in one job.
3. Buckets are brute-forced on the sketches; a bucket that no split makes small is compared part by part.  What looks
   similar is tied to stars, so no task writes pairs.
4. Exact check: the candidates' whole n-gram sets are compared within each candidate group, part by part.

Defined cases: null or empty text has no links; a null doc_id too, with null class and group; rows of one doc_id are one document,
that whose text has the smallest hash; result columns replace columns of their name; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import bounds, column, mixed, raw, ready, stored, word_hashes
from sentrymill.llm.groups import cells, compared, components, with_groups

N, SIMILAR = 5, 0.8
TOKENS, DEPTH, SMALL, RECALL = 64, 4, 250, 0.999
#: Standard errors by which a sketch may understate a similar pair.
SLACK = 3.5


def shingles(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, end to end, and the number per text."""
    words, counts = word_hashes(texts)
    if not len(words):
        return words, counts
    starts = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    rest = np.repeat(starts + counts, counts) - np.arange(len(words))
    gram = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            here = np.zeros(len(words), np.uint64)
            here[:len(words) - k] = words[k:]
            gram = np.where(rest > k, mixed(gram * np.uint64(0x100000001B3) + here), gram)
    first = np.zeros(len(words), bool)
    first[starts[counts > 0]] = True
    use = (rest >= n) | first & (rest < n)  # a short text is one n-gram, that of its first word
    doc, gram = doc[use], gram[use]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return gram[new], np.bincount(doc[new], minlength=len(texts))


def sketches(grams: np.ndarray, counts: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """One row of minhash tokens per non-empty set."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), tokens), np.uint32)
    factors = mixed(np.arange(1, 2 * tokens + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for k in range(tokens):
            h = (grams * (factors[2 * k] | np.uint64(1)) + factors[2 * k + 1]) >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(h.astype(np.uint32), starts)
    return out


def runs_for(recall: float = RECALL, similar: float = SIMILAR, depth: int = DEPTH) -> int:
    """Runs that keep a pair of the threshold's similarity together in one bucket at least, with this probability."""
    stays = 1.0
    for _ in range(depth):
        stays = 0.75 * similar * stays + 0.25 * (1 - (1 - similar * stays) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - stays))


def chosen(node: np.ndarray, tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The positions that a node splits on: one, and for a quarter of the nodes a second."""
    draw = mixed(node)
    one = (draw % np.uint64(tokens)).astype(np.int64)
    two = ((one + 1 + (draw >> np.uint64(8)) % np.uint64(tokens - 1)) % np.uint64(tokens)).astype(np.int64)
    return one, two, (draw >> np.uint64(40)) % np.uint64(4) == 0


def _children(node: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two, both = chosen(node)
    rows = np.arange(len(ids))
    keys, of = [], []
    for at, use in ((one, np.ones(len(ids), bool)), (two, both)):
        with np.errstate(over="ignore"):
            token = sketch[rows[use], at[use]].astype(np.uint64) * np.uint64(TOKENS) + at[use].astype(np.uint64)
            keys.append(mixed(node[use] * np.uint64(0xD1342543DE82EF95) + mixed(token)))
        of.append(ids[use])
    return np.concatenate(keys).view(np.int64), np.concatenate(of)


def _sketch(batch_column) -> np.ndarray:
    return np.frombuffer(b"".join(batch_column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, of, hi, lo, sketch) of each doc_id with words; hi and lo stand for the set of n-grams, of for the text."""

    def run(batches):
        for batch in batches:
            grams, counts = shingles(raw(batch.column(1)))
            some = counts > 0
            starts = (np.cumsum(counts) - counts)[some]
            if not len(starts):
                continue
            with np.errstate(over="ignore"):
                hi = np.add.reduceat(mixed(grams), starts)
                lo = np.add.reduceat(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)), starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(some)), batch.column(2).filter(pa.array(some)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                 pa.array([x.tobytes() for x in sketches(grams, counts)], pa.binary())], ["key", "of", "hi", "lo", "sketch"])

    rows = (docs.where(column(id_col).isNotNull())
            .select(column(id_col).cast("long").alias("key"), column(text_col).cast("string").alias("text"),
                    F.xxhash64(column(text_col)).alias("of"))
            .mapInArrow(run, "key long, of long, hi long, lo long, sketch binary"))
    return rows.groupBy("key").agg(F.min(F.struct("of", "hi", "lo", "sketch")).alias("_")).select("key", "_.*")


def buckets(sketch: DataFrame, runs: int, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(node, id) of all chosen-path buckets that are small or at the last depth."""

    def roots_of(batches):
        for batch in batches:
            ids, tokens = np.asarray(batch.column(0)), _sketch(batch.column(1))
            for run in range(runs):
                node = np.full(len(ids), run + 1, np.uint64)
                keys, of = _children(node, ids, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of)], ["node", "id"])

    def split(batches):
        for batch in batches:
            keys, of = _children(np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)), _sketch(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of)], ["node", "id"])

    now, done = sketch.select("id", "sketch").mapInArrow(roots_of, "node long, id long"), None
    for level in range(depth):
        now = stored(now)
        sizes = now.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        now = stored(now.join(sizes, "node"))  # alone in a bucket: nothing to compare
        last = level == depth - 1
        ended = (now if last else now.where(F.col("n") <= small)).select("node", "id")
        done = ended if done is None else done.unionByName(ended)
        large = now.where(F.col("n") > small)
        if last or large.isEmpty():
            break
        now = large.select("node", "id").join(sketch.select("id", "sketch"), "id").select("node", "id", "sketch").mapInArrow(
            split, "node long, id long")
    return done


def _looks_similar(similar: float):
    need = TOKENS * similar - SLACK * math.sqrt(TOKENS * similar * (1 - similar))

    def same(t: pa.Table):
        tokens = np.ascontiguousarray(_sketch(t.column("sketch")))
        return lambda i, j: (tokens[i] == tokens[j]).sum(1) >= need

    return same


def _is_similar(similar: float, n: int):
    """Exact: the sets of a table's rows are numbered once; a pair's common n-grams are counted on sorted numbers."""

    def same(t: pa.Table):
        cell = t.column("cell").to_numpy()
        grams, counts = shingles(raw(t.column("text")), n)
        ends = np.cumsum(counts)
        starts = ends - counts
        of_cell = bounds(cell)
        shared: dict[int, np.ndarray] = {}

        def common(c: int) -> np.ndarray:
            """Sizes of all intersections within a cell, as a product of incidence matrices, some n-grams at a time."""
            lo, hi = of_cell[c], of_cell[c + 1]
            rows = np.repeat(np.arange(hi - lo), counts[lo:hi])
            values, number, times = np.unique(grams[starts[lo]:ends[hi - 1]], return_inverse=True, return_counts=True)
            keep = times[number] > 1
            rows, number = rows[keep], np.cumsum(times > 1)[number[keep]] - 1
            order = np.argsort(number, kind="stable")
            rows, number = rows[order], number[order]
            out = np.zeros((hi - lo, hi - lo), np.float32)
            step = max(64, (1 << 22) // (hi - lo))
            for at in range(0, int(number[-1]) + 1 if len(number) else 0, step):
                a, b = np.searchsorted(number, [at, at + step])
                m = np.zeros((hi - lo, min(step, int(number[-1]) + 1 - at)), np.float32)
                m[rows[a:b], number[a:b] - at] = 1
                out += m @ m.T
            return out

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            c = np.searchsorted(of_cell, i, side="right") - 1
            both = np.empty(len(i))
            for k, (lo, hi) in zip(c[bounds(c)[:-1]].tolist(), zip(bounds(c)[:-1], bounds(c)[1:], strict=True), strict=True):
                if k not in shared:
                    shared.clear()  # pairs come cell by cell
                    shared[k] = common(k)
                both[lo:hi] = shared[k][i[lo:hi] - of_cell[k], j[lo:hi] - of_cell[k]]
            # in whole numbers, so that a similarity of exactly the threshold counts
            return both >= np.ceil(similar * (counts[i] + counts[j] - both) - 1e-9)

        return test

    return same


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR,
                   recall: float = RECALL, n: int = N, block: int = 400) -> DataFrame:
    """All rows and columns; class_id (smallest doc_id of the same n-grams), n_links (other documents with a similarity of ``similar``
    or more), group_id (smallest doc_id reached by links), kept (doc_id = group_id)."""
    ready(docs.sparkSession)
    every = stored(sketched(docs, id_col, text_col))
    classes = stored(every.groupBy("hi", "lo").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("copies")))
    sketch = stored(every.join(classes.select(F.col("id").alias("key"), "id", "copies"), "key").select("id", "copies", "of", "sketch"))
    near = cells(buckets(sketch, runs_for(recall, similar)), "node").join(sketch.select("id", "sketch"), "id")
    candidates = stored(components(compared(near, _looks_similar(similar))).withColumnRenamed("node", "id"))
    texts = (docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"),
                         F.xxhash64(column(text_col)).alias("of"))
             .join(sketch.join(candidates, "id").select("id", "of", "copies"), ["id", "of"]).dropDuplicates(["id"]))
    members = cells(candidates.select("id", "component"), "component", block).join(texts, "id")
    links = stored(compared(members, _is_similar(similar, n), "copies"))
    return with_groups(docs, id_col, every, classes, links, ("class_id", "n_links", "group_id", "kept"))
