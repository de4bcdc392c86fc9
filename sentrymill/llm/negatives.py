"""Hard-negative mining by inner product over cover trees.

Vectors become whole numbers, floor(scale * x), so scores are exact and reruns agree.

1. Candidates are dealt into blocks of bounded size: a large label into blocks of its own, small labels together.  Each block becomes
   a cover tree, stored as rows once.  Vectors of a block get one more component that brings them all to the norm of the longest, so
   they lie on a sphere and the greatest inner product is the least angle.  A node is a row and the cone around it; its
   children's cones have half the radius or less and cover its members between them, down to ``LEAF`` rows.  Rows are numbered depth first, so a node's
   members are a range.
2. A node with its centre at angle c from the anchor and covering radius r holds inner products from |q| M cos(c + r) to
   |q| M cos(c - r).  The descent takes the node with the greatest upper bound first, leaves out nodes that lie outside every
   window or below the k-th found in each, and verifies the rows of leaves exactly.
3. Positives are searched first (rows of the anchor's label, no window), then negatives (rows of other labels, one window for each
   positive: low_pct to high_pct of its score).  A task holds a bounded number of anchors and reads one block after the
   other, so what it has found sharpens the bounds for the next; candidates are dealt to a fixed number of groups, whose
   answers are merged per window.

Defined cases: rows with a null id, label or vector, an empty vector, or null or non-finite components take no part; rows of one id are one
row, that with the least label, then vector; vectors of different length do not meet; equal scores are ordered by id; a window without rows
gives none, nor does an anchor without positives; scores beyond 64 bits are cut to the ends of that range; only the result columns are given out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, ready, stored

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows of a block, rows of a leaf, anchors of a task, groups that the blocks are dealt to; they change no result.
BLOCK, LEAF, ANCHORS, GROUPS = 2_048, 8, 4_000, 48
_EXACT, _LONG = 1 << 53, (1 << 63) - 1
_SLACK = 1e-7  # of an angle's cosine, far above what rounding can do


def _whole(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) of the rows that take part, the vector as whole numbers in double precision."""
    for batch in batches:
        rows, data = [], []
        for i, v in enumerate(batch.column(2)):
            if v.is_valid and len(v.values):
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    rows.append(i)
                    data.append((x + 0.0).tobytes())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(data, pa.binary())],
                                         ["id", "label", "vector"])


def candidates(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: float, block: int) -> DataFrame:
    """(id, label, vector, block): ``block`` is a number that about ``block`` rows of one vector length share."""
    given = df.select(column(id_col).cast("long").alias("id"), label.alias("label"), column(vector_col).alias("v"))
    whole = isinstance(given.schema["label"].dataType, T.IntegralType)
    rows = (given.where("id is not null and label is not null")
            .select("id", (F.col("label").cast("long") if whole else F.xxhash64("label")).alias("label"), F.col("v").cast("array<double>").alias("v"))
            .mapInArrow(lambda batches: _whole(batches, scale), "id long, label long, vector binary"))
    once = stored(rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_")).select("id", "_.*"))
    size = F.length("vector")
    of_label = once.groupBy("label", size.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    large = of_label.withColumn("large", F.col("n") > block // 2)
    small = large.where("not large").groupBy("size").agg(F.sum("n").alias("rest"))
    parts = large.join(small, "size", "left").withColumn("parts", F.ceil(F.when(F.col("large"), F.col("n")).otherwise(F.col("rest")) / block))
    dealt = once.withColumn("size", size).join(parts, ["label", "size"])
    # a small label stays together, a large one is dealt by id
    part = F.when(F.col("large"), F.pmod(F.xxhash64("id"), "parts")).otherwise(F.pmod(F.xxhash64("label"), "parts"))
    return dealt.select("id", "label", "vector", F.xxhash64("size", F.when(F.col("large"), F.col("label")), part).alias("block"))


def _matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _sphere(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with one more component, at length 1, and the norm that this stands for."""
    large = max(1.0, float(np.abs(x).max(initial=0)))
    norms = np.einsum("ij,ij->i", x / large, x / large)
    most = float(norms.max(initial=0))
    if most == 0:
        return np.eye(1, x.shape[1] + 1, x.shape[1]).repeat(len(x), 0), 0.0
    unit = np.concatenate([x / large, np.sqrt(np.maximum(0, most - norms))[:, None]], 1) / math.sqrt(most)
    return unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None], large * math.sqrt(most)


def _angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to a vector; small ones from the differences' lengths, as cosines near 1 lose them."""
    cosine = unit @ centre
    out = np.arccos(np.clip(cosine, -1, 1))
    close = np.flatnonzero(cosine > 0.99)
    d = unit[close] - centre
    out[close] = 2 * np.arcsin(np.minimum(1, np.sqrt(np.einsum("ij,ij->i", d, d)) / 2))
    return out


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """Order of the rows depth first, and the nodes (depth, start, end, covering radius); a node's centre is its first row."""
    unit, _ = _sphere(x)
    order = np.zeros(len(x), np.int64)
    nodes: list[tuple[int, int, int, float]] = []
    todo = [(0, 0, np.arange(len(x)), _angles(unit, unit[0]))] if len(x) else []
    while todo:
        depth, start, rows, away = todo.pop()
        radius = float(away.max())
        nodes.append((depth, start, start + len(rows), radius))
        order[start:start + len(rows)] = rows
        if len(rows) <= leaf or radius == 0:
            continue
        # the centre covers first, then the next row that nothing covers yet, until all are covered
        open_, at, here = np.ones(len(rows), bool), start, unit[rows]
        while True:
            near = open_ & (away <= radius / 2)
            todo.append((depth + 1, at, rows[near], away[near]))
            at += int(near.sum())
            open_ &= ~near
            if not open_.any():
                break
            if 2 * open_.sum() < len(rows):
                rows, here, open_ = rows[open_], here[open_], open_[open_]
            away = _angles(here, here[int(open_.argmax())])
    return order, nodes


def _steps(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, those with equal keys together, one set after the other."""
    held: list[pa.RecordBatch] = []
    of = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], 1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and of != values[a].tolist():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            of = values[a].tolist()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _treed(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks as rows of their trees: place, and the (depth, end, radius) of the nodes that a row is the centre of."""
    for part in _steps(batches, "block"):
        order, nodes = cover_tree(_matrix(part.column("vector").to_pylist()), leaf)
        cones: list[list[tuple]] = [[] for _ in order]
        for depth, start, end, radius in nodes:
            cones[start].append((depth, end, radius))
        part = part.take(pa.array(order))
        yield pa.RecordBatch.from_arrays(
            [part.column(c) for c in ("block", "id", "label", "vector")]
            + [pa.array(np.arange(len(order))), pa.array([np.array(c, np.float64).tobytes() for c in cones], pa.binary())],
            ["block", "id", "label", "vector", "place", "cones"])


def tree_rows(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The cover trees of all blocks, a row each for the candidates."""
    return (rows.select("block", "id", "label", "vector").repartition("block").sortWithinPartitions("block", "id")
            .mapInArrow(lambda batches: _treed(batches, leaf),
                        "block long, id long, label long, vector binary, place long, cones binary"))


class Tree:
    """One block: rows depth first, nodes by depth, then start; the children of a node lie together."""

    def __init__(self, table: pa.RecordBatch):
        order = np.argsort(table.column("place").to_numpy())
        self.x = _matrix(table.column("vector").to_pylist())[order]
        self.ids, self.labels = (table.column(c).to_numpy()[order] for c in ("id", "label"))
        cones = [np.frombuffer(c, np.float64).reshape(-1, 3) for c in table.column("cones").to_pylist()]
        cones = [cones[i] for i in order]
        start = np.repeat(np.arange(len(cones)), [len(c) for c in cones])
        depth, end, radius = np.concatenate(cones).T
        by = np.lexsort((start, depth))
        self.start, self.end, self.radius = start[by], end[by].astype(np.int64), radius[by]
        self.depth = depth[by].astype(np.int64)
        key = self.depth * (len(cones) + 1) + self.start
        below = (self.depth + 1) * (len(cones) + 1)
        self.child = np.searchsorted(key, below + self.start)
        self.beyond = np.searchsorted(key, below + self.end)
        self.unit, self.norm = _sphere(self.x)
        self.most = float(np.abs(self.x).max(initial=0))
        self.one_label = int(self.labels[0]) if (self.labels == self.labels[0]).all() else None


class Window:
    """The ``k`` best rows so far with a score from low to high, best first."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a score has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score >= self.least()) & (score <= self.high)
        if ok.any():
            score, ids = np.concatenate([self.score, score[ok]]), np.concatenate([self.id, ids[ok]])
            best = np.lexsort((ids, -score if score.min() > -_LONG else [-int(s) for s in score]))[:self.k]
            self.score, self.id = score[best], ids[best]


def _scores(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as 64-bit numbers; doubles hold them where all sums stay below 2 ** 53."""
    if x.shape[1] * most * float(np.abs(q).max(initial=0)) < _EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    sums = (sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x)
    return np.array([max(-_LONG, min(_LONG, s)) for s in sums], np.int64)


def search(tree: Tree, q: np.ndarray, own: int, label: int, same: bool, windows: list[Window]) -> int:
    """Best-first descent for one anchor; returns how many rows were verified."""
    if tree.x.shape[1] != len(q) or tree.one_label is not None and (tree.one_label == label) != same:
        return 0
    large = max(1.0, float(np.abs(q).max(initial=0)))
    size = large * math.sqrt(float((q / large) @ (q / large)))
    reach = size * tree.norm
    direction = np.append(q / size, 0.0) if size else np.zeros(len(q) + 1)
    verified = 0

    def verify(rows: np.ndarray) -> None:
        nonlocal verified
        verified += len(rows)
        ids = tree.ids[rows]
        ok = ((tree.labels[rows] == label) == same) & (ids != own)
        score = _scores(tree.x[rows], q, tree.most)[ok]
        for w in windows:
            w.offer(score, ids[ok])

    def inside(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that some window needs, and their upper bounds."""
        away = np.arccos(np.clip(tree.unit[tree.start[node]] @ direction, -1, 1))
        upper = reach * (np.cos(np.maximum(0, away - tree.radius[node])) + _SLACK) + 1
        lower = reach * (np.cos(np.minimum(math.pi, away + tree.radius[node])) - _SLACK) - 1
        need = np.zeros(len(node), bool)
        for w in windows:
            need |= (upper >= w.least()) & (lower <= w.high)
        return node[need], upper[need]

    heap: list[tuple[float, int]] = []

    def push(node: np.ndarray) -> None:
        node, upper = inside(node)
        single = tree.end[node] - tree.start[node] == 1
        if single.any():
            verify(tree.start[node[single]])
        for u, n in zip((-upper[~single]).tolist(), node[~single].tolist(), strict=True):
            heappush(heap, (u, n))

    push(np.zeros(1, np.int64))
    while heap:
        upper, node = heappop(heap)
        if -upper < min(w.least() for w in windows):
            break  # nothing that is left reaches a window
        if tree.child[node] == tree.beyond[node]:
            verify(np.arange(tree.start[node], tree.end[node]))
        else:
            push(np.arange(tree.child[node], tree.beyond[node]))
    return verified


def _searched(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Per task key first its anchors, then its blocks, one after the other."""
    key, anchors = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        for own, _, _, windows in anchors:
            for nth, w in enumerate(windows):
                if len(w.id):
                    n = len(w.id)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * n, pa.int64()), pa.array([nth] * n, pa.int64()), pa.array(w.id), pa.array(w.score)],
                                                     ["anchor", "nth", "id", "score"])

    for part in _steps(batches, "task", "kind", "block"):
        if part.column("task")[0].as_py() != key:
            yield from answers()
            key, anchors = part.column("task")[0].as_py(), []
        if part.column("kind")[0].as_py() == 0:
            for own, label, vector, low, high in zip(*(part.column(c).to_pylist() for c in ("id", "label", "vector", "low", "high")), strict=True):
                windows = [Window(a, b, k) for a, b in zip(low, high, strict=True)]
                anchors.append((own, label, np.frombuffer(vector, np.float64), windows))
        elif anchors:
            tree = Tree(part)
            for own, label, q, windows in anchors:
                search(tree, q, own, label, same, windows)
    yield from answers()


def searched(anchors: DataFrame, trees: DataFrame, same: bool, k: int, tasks: int, groups: int) -> DataFrame:
    """(anchor, nth, id, score): the k best candidates for each window of each anchor.

    ``anchors`` has (id, label, vector, low, high), with one low and high per window.  A task is one of ``tasks`` sets of
    anchors with one of ``groups`` sets of blocks.
    """
    nothing = F.lit(None)
    each = F.sequence(F.lit(0), F.lit(groups - 1))
    left = anchors.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(tasks)).alias("of"), F.explode(each).alias("group"), F.lit(0).alias("kind"),
                          nothing.cast("long").alias("block"), "id", "label", "vector", nothing.cast("long").alias("place"),
                          nothing.cast("binary").alias("cones"), "low", "high")
    right = trees.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("of"),
                         F.pmod(F.xxhash64("block", F.lit(6)), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "block", "id", "label", "vector",
                         "place", "cones", nothing.cast("array<long>").alias("low"), nothing.cast("array<long>").alias("high"))
    both = left.unionByName(right).withColumn("task", F.col("of") * groups + F.col("group")).drop("of", "group")
    found = (both.repartition(tasks * groups, "task").sortWithinPartitions("task", "kind", "block")
             .mapInArrow(lambda batches: _searched(batches, same, k), "anchor long, nth long, id long, score long"))
    best = F.row_number().over(Over.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))  # k rows a group at most
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
                   scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW,
                   high_pct: int = HIGH, block: int = BLOCK, anchors_of_task: int = ANCHORS, groups: int = GROUPS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says of a candidate's ``id`` whether it is an anchor.  An anchor's positives are its ``positives`` best other rows of its label; the negatives
    of each are the ``negatives`` best rows of other labels that score low_pct to high_pct percent of it.
    """
    ready(df.sparkSession)
    rows = stored(candidates(df, id_col, F.col("label") if label is None else label, vector_col, scale, block))
    trees = stored(tree_rows(rows))
    asked = rows.where(anchor).select("id", "label", "vector")
    tasks = max(1, math.ceil(asked.count() / anchors_of_task))
    every = F.array(F.lit(-_LONG)), F.array(F.lit(_LONG))
    found = stored(searched(asked.select("*", every[0].alias("low"), every[1].alias("high")), trees, True, positives, tasks, groups)
                   .select(F.col("anchor").alias("id"), F.col("rank").cast("long").alias("nth"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score")))
    # low_pct * positive <= 100 * score <= high_pct * positive, in decimals that hold all of it
    low, high = (F.col("positive_score").cast("decimal(20,0)") * F.lit(pct).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
                 for pct in (low_pct, high_pct))
    window = F.struct("nth", F.ceil(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high"))
    windows = (found.select("id", window.alias("w")).groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # ``positives`` at most
               .select("id", F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    mined = searched(asked.join(windows, "id"), trees, False, negatives, tasks, groups)
    return (mined.select(F.col("anchor").alias("anchor_id"), (F.col("nth") + 1).alias("nth"), F.col("rank").cast("int").alias("rank"),
                         F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(found.withColumnRenamed("id", "anchor_id"), ["anchor_id", "nth"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
