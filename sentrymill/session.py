"""Session settings, durable intermediate tables, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runtime settings the jobs rely on.  Sizes are left to the cluster: adaptive
# execution coalesces or splits shuffle partitions from what it measures.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # later duplicates win, as in the header, event and metric maps we model
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

SALTS = 32


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a private one only for local sessions."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="sentrymill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so lost executors do not recompute it.

    Rows are kept as compressed columns: what is stored once and read several times takes a small part of the disk that a
    checkpoint of whole rows takes, and each reader gets its own columns only.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    if "void" in df.schema.simpleString():  # columns without a type cannot be written as columns
        return df.checkpoint()
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        # \u0024 keeps a "${...}" in the text from being taken for a variable reference
        value = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
        return "'" + value + "'"
    return str(value)


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small constant dimension, known to the optimizer with its exact size."""
    cells = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(columns)})")


def once(c: Column) -> Column:
    """Evaluate an expensive expression a single time per row.

    Filters on a projected column are pushed below the projection together
    with a copy of its expression; they are not pushed below a generator.
    """
    return F.explode(F.array(c))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                condition: Column | None = None, salts: int | None = None) -> DataFrame:
    """Equi-join whose left side may have a key holding a large share of its rows.

    By default the join is left to adaptive execution, which broadcasts a side that it has measured to be small and splits
    the left part of a partition that it has measured to be skewed.  A caller who knows the right side to be
    small beside a skewed left one asks for ``salts``: each left row draws one, and the right side is copied for each.  A stream
    always draws salts, as its micro-batches are not split adaptively.
    ``keys`` must have the same names on both sides; ``condition`` is a residual over both.
    """
    salts = salts or (SALTS if left.isStreaming else 1)
    if salts < 2:
        salted_left, salted_right, on = left, right, list(keys)
    else:
        row_hash = F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes
                                if "map<" not in t and c != "content"])
        salted_left = left.withColumn("_salt", F.pmod(row_hash, F.lit(salts)).cast("int"))
        salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [*keys, "_salt"]
    # equality only on the keys, the residual inside the same join
    marked = salted_right.select(*[F.col(f"`{c}`").alias(f"_r_{c}" if c in on else c) for c in salted_right.columns])
    match = F.lit(True)
    for key in on:
        match = match & (F.col(key) == F.col(f"_r_{key}"))
    if condition is not None:
        match = match & condition
    return salted_left.join(marked, match, how).drop("_salt", *[f"_r_{k}" for k in on])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str, few: int = 0) -> DataFrame:
    """0-based position of each row within its group, without one task per group.

    A window function would send a whole group to one task.  Here rows are
    range-partitioned by (group, order), so a large group spans many
    partitions; the offset of a partition within a group comes from the counts
    of the partitions before it, a table with one row per (partition, group).
    A caller with wide rows may have that table broadcast where it has up to
    ``few`` rows, so that the stored rows are not shuffled once more to meet it.
    """
    along = [F.col(c) if isinstance(c, str) else c for c in (*group, *order)]
    ranged = durable(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    keys = list(group)
    counts = (ranged.groupBy(*keys, part.alias("_part"))
              .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = _prefix_by_partition(counts, keys)
    if few:
        before = durable(before)
        few = before.count() <= few
    joined = ranged.withColumn("_part", part)
    return (spread_join(joined, F.broadcast(before) if few else before, [*keys, "_part"])
            .select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name)))


def _prefix_by_partition(counts: DataFrame, keys: list[str]) -> DataFrame:
    # one row per partition a group touches: at most the number of partitions per group
    from pyspark.sql import Window
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0).cast(T.LongType())))
