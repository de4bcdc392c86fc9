"""Comparing the members of groups, however large, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import bounds, column, others, pairs_within, roots, stored, whole_groups

#: Members of one group that meet in one task, and pairs that are compared in one numpy step.
BLOCK, PAIRS = 1_000, 100_000
FOUND = "id long, root long, links long"


def cells(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(cell, part, split, id) of the rows' groups with two members or more.

    A group of up to ``block`` members is one cell.  A larger one is dealt into parts, and each two parts meet in
    one cell, so every pair of members meets once outside the parts' own cells and no task holds more than two
    parts.  ``split`` marks the cells of two different parts, where members of one part are not compared again.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / block)
    dealt = (rows.join(sizes, group)
             .withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), parts))
             .withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))))
    return dealt.select(F.xxhash64(group, F.least("part", "_with"), F.greatest("part", "_with")).alias("cell"),
                        F.col(group).alias("_of"), "part", (F.col("part") != F.col("_with")).alias("split"), "id")


def _pairs(t: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cell, of, part, split = (t.column(c).to_numpy() for c in ("cell", "_of", "part", "split"))
    for i, j in pairs_within(bounds(cell), most):
        # two groups can share a cell's number; members of one part are compared in the part's own cell
        ok = (of[i] == of[j]) & (split[i] == split[j]) & (~split[i] | (part[i] != part[j]))
        yield i[ok], j[ok]


def found(ids: np.ndarray, weights: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """One row per linked member: the smallest id it reaches by these links, and the weight of its partners."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.argsort(ids[nodes], kind="stable")  # so that the smallest index is the smallest id
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    a, b = rank[at[:len(i)]], rank[at[len(i):]]
    label = roots(len(nodes), a, b)
    own = ids[nodes][order]
    links = np.bincount(a, weights[j], len(nodes)) + np.bincount(b, weights[i], len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[label]), pa.array(links.astype(np.int64))], ["id", "root", "links"])


def compared(members: DataFrame, same: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]],
             weight: str | None = None) -> DataFrame:
    """Compares the members of each cell; (id, root, links) of the linked ones, a few rows per member and cell.

    ``same`` prepares a table of whole cells and returns a function that says of index pairs whether they are linked.
    """

    def run(batches):
        for t in whole_groups(batches, "cell"):
            test = same(t)
            ids = t.column("id").to_numpy()
            weights = t.column(weight).to_numpy() if weight else np.ones(len(ids), np.int64)
            for i, j in _pairs(t, PAIRS):
                if len(i):
                    ok = test(i, j)
                    if ok.any():
                        yield found(ids, weights, i[ok], j[ok])

    return members.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, FOUND)


def components(edges: DataFrame, a: str = "id", b: str = "root") -> DataFrame:
    """(node, component) of all nodes of the edges; a component's id is its smallest node.

    Alternates small stars and large stars (every node's neighbours are tied to its smallest neighbour) until each
    larger node has one edge, to its component's smallest.  Each round is stored; no component is gathered in one place.
    """
    high, low = F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    now = stored(edges.where(F.col(a) != F.col(b)).select(high, low).distinct())
    while True:
        ends = now.select(F.col("x").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("y").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_nodes = (ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                      .where("up > 1 or (up = 1 and down = 1)"))
        if open_nodes.isEmpty():
            break
        least = now.groupBy("x").agg(F.min("y").alias("m"))
        small = (now.join(least, "x").select(F.inline(F.array(F.struct(F.col("x").alias("x"), F.col("m").alias("y")),
                                                              F.struct(F.col("y").alias("x"), F.col("m").alias("y")))))
                 .where("x <> y").distinct())
        small = stored(small)
        both = small.unionByName(small.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        now = stored(both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
                     .where("x <> y").distinct())
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
        now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def with_groups(df: DataFrame, id_col: str, every: DataFrame, classes: DataFrame, links: DataFrame,
                names: tuple[str, str, str, str]) -> DataFrame:
    """All rows and columns of ``df`` with class, number of links, component and kept, under the given names.

    ``every`` has (key, hi, lo) for each id, ``classes`` (hi, lo, id, copies) for each set of equal contents, ``links``
    (id, root, links) of the linked classes.  Ids without contents are alone: no links, their own class and component.
    """
    linked = links.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = (classes.join(linked, "id", "left")
                .join(components(links).select(F.col("node").alias("id"), "component"), "id", "left")
                .select("hi", "lo", F.col("id").alias("_class_"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links_"),
                        F.coalesce("component", "id").alias("_component_")))
    result = every.select("key", "hi", "lo").join(of_class, ["hi", "lo"]).drop("hi", "lo").withColumnRenamed("key", "_key_")
    here = column(id_col).cast("long")
    kept = others(df, *names)
    joined = df.select(*[column(c) for c in kept], here.alias("_here_")).join(result, F.col("_here_") == F.col("_key_"), "left")
    values = [F.coalesce("_class_", "_here_"), F.coalesce("_links_", F.lit(0).cast("long")), F.coalesce("_component_", "_here_"),
              F.coalesce(F.col("_here_") == F.col("_component_"), F.lit(True))]
    return joined.select(*[column(c) for c in kept], *[v.alias(n) for v, n in zip(values, names, strict=True)])
