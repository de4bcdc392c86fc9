"""Mixing sources to target weights with a low-discrepancy schedule.

Sources, ordered by code point with null last, get weights 5, 2, 1, repeating, and share ``total`` times all words.  A target stops at
``most`` times its source's words; the excess is shared by weight among the rest until none is above.

The documents of a source, shuffled by a hash anew for each pass over it, are one stream of words, cut into blocks of ``block``
words.  Slot i of the schedule lies at the fractional part of i times the golden ratio; the source whose interval of
cumulated targets holds it gives its next block there.  Slots are ranked per source by counts of whole chunks of the schedule and
ranks inside a chunk, so no source's slots meet in one task; a slot's rank is the number of its block.  The last block of
a source ends at its target; slots that rounding leaves open follow at the end.

A document's place in its stream is a running sum over hash ranges of bounded size and a sum over the ranges before.

Defined cases: null or empty texts have no words and are never taken; rows that agree in id, source and text are one document; a
null id or source is a value like any other; a source without words has the target 0; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.common import column, map_batches, pieces, raw, ready, stored

WEIGHTS, TOTAL, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK = 256
_CHUNK, _RANGE = 1 << 14, 100_000
_GOLDEN = 0x9E3779B97F4A7C15  # 2 ** 64 / golden ratio


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares by weight of ``total`` times all sizes, each at most ``most`` times its size."""
    out = [0.0] * len(sizes)
    left, open_at = total * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_at:
        unit = left / sum(weights[i] for i in open_at)
        over = [i for i in open_at if weights[i] * unit > most * sizes[i]]
        for i in over or open_at:
            out[i] = most * sizes[i] if over else weights[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_at = [i for i in open_at if i not in set(over)]
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc, source, of, size) of each document; of stands for its text."""

    def run(batches):
        for batch in batches:
            size = [len(t.split()) for t in raw(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64())],
                                             ["doc", "source", "of", "size"])

    return (docs.select(column(id_col).cast("long").alias("doc"), column(source_col).cast("string").alias("source"),
                        text_of(text_col).alias("of"), column(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc long, source string, of long, size long").dropDuplicates(["doc", "source", "of"]))


def text_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(column(text_col).cast("string"), F.lit("")))


def schedule(spark, words: list[int], block: int = BLOCK, chunk: int = _CHUNK) -> DataFrame:
    """(slot, at, rank): source number and how many slots it had before, for whole words to take of each source."""
    need = np.array([pieces(w, block) if w else 0 for w in words], np.int64)
    total = int(need.sum())
    edges = np.cumsum(words) / max(1, sum(words))

    def run(batches):
        for batch in batches:
            for c in np.asarray(batch.column(0)).tolist():
                slot = np.arange(c * chunk, min(total, (c + 1) * chunk), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    point = (slot * np.uint64(_GOLDEN)) >> np.uint64(11)
                at = np.minimum(np.searchsorted(edges, point.astype(np.float64) / 2.0 ** 53, side="right"), len(need) - 1)
                found = np.unique(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), c, np.int64)), pa.array(found.astype(np.int32)),
                     pa.array([slot[at == s].astype(np.int64) for s in found], pa.list_(pa.int64()))], ["chunk", "at", "slots"])

    chunks = stored(spark.range(pieces(total, chunk) if total else 0).mapInArrow(run, "chunk long, at int, slots array<long>"))
    # one row per source and chunk
    before = F.sum("_n").over(Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    ranked = (chunks.withColumn("_n", F.size("slots").cast("long")).withColumn("_before", F.coalesce(before, F.lit(0).cast("long")))
              .select("at", "_before", F.posexplode("slots").alias("_i", "slot"))
              .select("slot", "at", (F.col("_before") + F.col("_i")).alias("rank")))
    hits = {r["at"]: r["n"] for r in chunks.groupBy("at").agg(F.sum(F.size("slots")).alias("n")).collect()}
    wanted = F.element_at(F.array(*[F.lit(int(n)) for n in need]), F.col("at") + 1) if len(need) else F.lit(0)
    late, at_slot = [], total
    for s, n in enumerate(need.tolist()):
        if hits.get(s, 0) < n:
            late.append((at_slot, s, hits.get(s, 0), n - hits.get(s, 0)))
            at_slot += n - hits.get(s, 0)
    kept = ranked.where(F.col("rank") < wanted)
    if not late:
        return kept
    tail = spark.createDataFrame(late, "first long, at int, done long, n long")
    return kept.unionByName(tail.select("first", "at", "done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
                            .select((F.col("first") + F.col("i")).alias("slot"), "at", (F.col("done") + F.col("i")).alias("rank")))


def mixed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
                 seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, source, of, size, source_size, target) and the mix: (slot, doc, source, of, pass, first, words) in the
    order of slots, where a piece is ``words`` words of the document from word ``first`` on."""
    spark = ready(docs.sparkSession)
    every = stored(sized(docs, id_col, text_col, source_col))
    # one row per source
    totals = sorted(every.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect(),
                    key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in totals]
    target = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    words = [min(2 * n, round(t)) for n, t in zip(sizes, target, strict=True)]
    of_source = spark.createDataFrame(
        [(r["source"], i, sizes[i], target[i], words[i]) for i, r in enumerate(totals)],
        "source string, at int, source_size long, target double, taken long").withColumnRenamed("source", "_source")
    # the table has one row per source and is made here; a hot source must not become one task of the join
    known = every.join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = pieces(sum(r["n"] for r in totals), _RANGE) * 16
    pass_ = F.explode(F.sequence(F.lit(0), F.when(F.col("taken") > F.col("source_size"), 1).otherwise(0))).alias("pass")
    dealt = (known.where("size > 0 and taken > 0").select("at", "doc", "source", "of", "size", "source_size", "taken", pass_)
             .withColumn("_order", F.xxhash64("doc", "of", "pass", F.lit(seed)))
             .withColumn("_range", F.pmod(F.col("_order"), F.lit(ranges))))
    inside = Window.partitionBy("at", "pass", "_range").orderBy("_order", "doc", "of")
    placed = stored(dealt.withColumn("_start", F.sum("size").over(inside) - F.col("size")))
    of_range = placed.groupBy("at", "pass", "_range").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("at", "pass").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_range.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).drop("_n")
    start = F.col("_start") + F.col("_offset") + F.col("pass") * F.col("source_size")
    stream = (placed.join(offsets, ["at", "pass", "_range"])
              .withColumn("_from", start).withColumn("_to", F.least(start + F.col("size"), F.col("taken"))).where("_from < _to"))
    number = F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("rank")
    cut = (stream.select("at", "doc", "source", "of", "pass", "_from", "_to", number)
           .withColumn("first", F.greatest(F.col("_from"), F.col("rank") * block))
           .withColumn("words", F.least(F.col("_to"), (F.col("rank") + 1) * block) - F.col("first"))
           .withColumn("first", F.col("first") - F.col("_from")))
    mix = schedule(spark, words, block).join(cut, ["at", "rank"]).select("slot", "doc", "source", "of", "pass", "first", "words")
    return known.drop("at", "taken"), mix


def taken(documents: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents with the words that the mix takes of them, repeats counted."""
    used = mix.groupBy("doc", "source", "of").agg(F.sum("words").alias("taken")).toDF("_doc", "_source", "_of", "_taken")
    same = (F.col("doc").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("of") == F.col("_of")))
    return (documents.join(used, same, "left").select(*documents.columns, F.coalesce("_taken", F.lit(0).cast("long")).alias("taken")))


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    words = text.split(None, n)
    if len(words) <= n:
        return text
    return text[:len(text) - len(words[n])].rstrip()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: one row, with all columns, for each pass that takes words of a document; the text is whole, or
    where the target ends inside it, its first words.  Rows that agree in id, source and text are one row here too, any of them."""
    documents, mix = mixed_pieces(docs, id_col, text_col, source_col, **options)
    used = mix.groupBy("doc", "source", "of", "pass").agg(F.sum("words").alias("_words"))
    key = lambda doc, source: [F.coalesce(doc, F.lit(0).cast("long")).alias("_doc"), doc.isNull().alias("_no_doc"),
                               F.coalesce(source, F.lit("")).alias("_source"), source.isNull().alias("_no_source")]
    keys = ["_doc", "_no_doc", "_source", "_no_source", "_of"]  # without nulls, so that one shuffle serves both steps
    body = [F.struct(*[column(c) for c in docs.columns]).alias("_body")]
    once = (docs.select(*body, *key(column(id_col).cast("long"), column(source_col).cast("string")), text_of(text_col).alias("_of"))
            .dropDuplicates(keys))
    found = once.join(used.select(*key(F.col("doc"), F.col("source")), F.col("of").alias("_of"), "_words"), keys)
    place, schema = docs.columns.index(text_col), docs.schema

    def cut(batches):
        for batch in batches:
            texts = [first_words(t, n) for t, n in zip(raw(batch.column(place)), batch.column(len(schema)).to_pylist(), strict=True)]
            columns = batch.columns[:len(schema)]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_batches(found.select(*[F.col(f"_body.`{c}`").alias(c) for c in docs.columns], "_words"), cut, schema)
