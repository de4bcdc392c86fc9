"""From documents to training text: toxicity, line dedup, near copies, mixing, SentencePiece.

A table may have any further columns, whatever their names (``kept``, ``score``, ``a.b``, the same name in capitals): stages work under
names of their own and give the columns back as they came.  The last stage's results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm import jaccard, lines, mixing, tokens, toxicity
from sentrymill.llm.common import stored

RESULTS = ("ids", "nbest_ids", "scores", "round_trip")


def renamed(docs: DataFrame, stage: Callable[[DataFrame, str, str, str], DataFrame], *results: str, rewritten: bool = False) -> DataFrame:
    """``stage(plain, id, text, source)`` over the table under plain names; ``results`` come last.  Where texts are ``rewritten``,
    n_chars follows them."""
    names = docs.columns
    plain = [f"c{i}_" for i in range(len(names))]
    out = stage(docs.toDF(*plain), *(plain[names.index(c)] for c in ("doc_id", "text", "source")))
    if rewritten and "n_chars" in names:
        length = F.length(plain[names.index("text")]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(plain[names.index("n_chars")], length)
    given = [(p, n) for p, n in zip(plain, names, strict=True) if n.lower() not in results]
    return out.select(*[F.col(p).alias(n) for p, n in given], *results)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(plain, doc_id, text, source):
        known = plain.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        model = toxicity.fitted(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return toxicity.scored(plain, model, text_col=text).where("predicted = 0")

    return renamed(docs, stage)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return renamed(docs, lambda plain, doc_id, text, source: lines.dedup_lines(plain, id_col=doc_id, text_col=text), rewritten=True)


def _keyed(plain: DataFrame, doc_id: str, text: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a key of their document, and the documents, without text: key, and the order in which groups keep one."""
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("id"),
                     F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("of"))
    rows = plain.withColumn("_order", order).withColumn("_key", F.xxhash64("_order", F.lit(seed)))
    return rows, rows.select("_key", "_order").distinct()


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group.  A document is a (doc_id, text), a null doc_id included: its repeated rows are one, and texts that share
    an id are compared as documents of their own.  A group keeps its first by doc_id, null last.  Documents go by a 64-bit
    key, drawn anew in case two share one; texts move only where they are compared, and once more for those that stay."""

    def stage(plain, doc_id, text, source):
        seed = 0
        while True:
            rows, documents = _keyed(plain, doc_id, text, seed)
            documents = stored(documents)
            if documents.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
                break
            seed += 1
        found = jaccard.jaccard_groups(rows.select("_key", F.col(text).alias("text")), "_key").select("_key", "group_id")
        first = (found.distinct().join(documents, "_key").groupBy("group_id").agg(F.min_by("_key", "_order").alias("_key"))
                 .select("_key"))
        kept = rows.drop("_order").join(stored(first), "_key")
        body = F.struct(*plain.columns)
        # of a document's repeated rows one stays; the join has brought them together
        any_of = kept.select("_key", body.alias("_body"), F.xxhash64(*plain.columns).alias("_of"))
        return any_of.groupBy("_key").agg(F.min_by("_body", "_of").alias("_body")).select("_body.*")

    return renamed(docs, stage)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass over a document; n_chars follows the text."""
    return renamed(docs, lambda plain, doc_id, text, source: mixing.mixed_documents(plain, doc_id, text, source), rewritten=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return renamed(docs, lambda plain, doc_id, text, source: tokens.encoded(plain, text_col=text), *RESULTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
