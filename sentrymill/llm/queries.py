"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.llm import byte_pairs, jaccard, lines, mixing, negatives, periodic, quality, quotes, secret_forest, tokens, toxicity, vectors, warc
from sentrymill.llm.common import WORD
from sentrymill.session import checkpoint_folder, let

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def token_digest(ids):
    """Hex SHA-256 of packed ids."""
    return F.sha2(ids, 256)


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.encoded(given(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    found = found.withColumn("nbest_sha256", F.transform("nbest_ids", token_digest))
    return found.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.get("nbest_sha256", F.lit(0)).alias("ids_sha256"), "scores",
                        "nbest_sha256", "round_trip")


@query()
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, mix = mixing.mixed_pieces(given(spark, sf_dir, "documents"))
    return mixing.taken(documents, mix).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


_BLANKS = r"[\x20\x09-\x0D]+"


@query(rf"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{_BLANKS}|{_BLANKS}$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
held AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, coalesce(first <> doc_id, false) AS dropped FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(given(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op4_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.reply_ordered(quotes.with_quotes(given(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", "place", "parent", "depth", "position", "quote_levels", "n_linked",
                        F.sha2("own_text", 256).alias("own_sha256"))


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    warc.write_archives(given(spark, sf_dir, "pages"), folder)
    found = warc.pages_of(warc.read_archives(spark, folder))
    sound = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest"))  # null if the bytes read are others
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


@query()
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(given(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    model = quality.fitted(docs, given(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text"), model).drop("text")


@query()
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_groups(given(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "group_id", "kept")


@query()
def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_forest.secret_findings(given(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "at", "run", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, given(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_pairs.encoded(given(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    found = byte_pairs.decoded(found.select("doc_id", "ids"))
    return found.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them with a passage that repeats: h = crc32(doc_id), g = h div 10; where h ends in 0, each word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("long")

        def of(places):
            a, p = places["a"], places["p"]
            return F.transform(words, lambda _, i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

        start = let(F.when(n > 0, g % n), lambda a: F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")))
        return F.array_join(let(start, of), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


@query()
def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(given(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    best = periodic.longest(F.col("runs"))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.array_join(lines_, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"))


@query()
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(given(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
