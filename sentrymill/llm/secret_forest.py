"""Secret candidates judged by a random forest.

Built-in expressions and Spark's own forest only.  A candidate is a run of ``LEAST`` or more token characters, a digit among them; a
word gives all of its runs (name="value", URLs, minified JSON).  Its features:

- length, share of digits, distinct characters, case changes;
- mean log probability of its character transitions, by counts over all words of all texts;
- coverage by a dictionary, the ``DICTIONARY`` most frequent words of all texts;
- the path: depth, and whether it speaks of tests, samples or documentation;
- neighbouring words: whether they are in the dictionary, name a credential, or assign.

The forest is trained on at most ``MOST`` labelled findings per class (a documented bound).  Findings that it
rejects are the false positives to remove.

Defined cases: null and empty texts have no candidates; a null path has depth 0; a null id passes through; repeated rows give repeated
findings; without labelled findings of both classes every probability is the share of label 1 (1 if there are none, so nothing is
removed); the result has its own columns, so other columns of the input cannot clash.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import column, ready, stored

LEAST, DICTIONARY, MOST = 12, 2_000, 5_000
TREES, DEPTH = 30, 6
_TOKEN = r"[A-Za-z0-9+/_=\-]{%d,}"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_KINDS = len(_LETTERS) + 1
CREDENTIAL = r"(?i)(token|secret|passw|passphrase|credential|api[_-]?key|auth|bearer|private[_-]?key)"
QUIET = r"(?i)(test|sample|example|fixture|mock|doc|readme)"
FEATURES = ["size", "digits", "distinct", "changes", "transitions", "coverage", "path_depth", "path_quiet",
            "before_known", "after_known", "names_credential", "assigned"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least: int = LEAST) -> DataFrame:
    """(id, path, at, run, candidate, before2, before, lead, tail, after), one row per candidate; at counts words from 0, run the
    candidates of the word.

    lead and tail are the word's own text around the candidate, up to the run before and to the run after it, inside one field of
    a list.  Neighbouring words stand with the word's first and last candidate only, so a long word is not copied for each of its
    candidates; the others keep what names a credential there, as before2.
    """
    words = F.split(column(text_col).cast("string"), r"[\x20\x09-\x0D]+")
    fits = lambda w: (F.length(w) >= least) & w.rlike("[0-9]") & w.rlike(_TOKEN % least)
    at = F.filter(F.transform("_words", lambda w, i: F.when(fits(w), i)), lambda i: i.isNotNull())
    word = lambda k: F.coalesce(F.get("_words", F.col("at") + k), F.lit(""))
    runs, between = F.col("_runs"), F.col("_between")  # a run has the text before it at its own place
    fields = lambda c: F.translate(c, ";&{}", ",,,,")
    every = F.transform(F.sequence(F.lit(0), F.size(runs) - 1), lambda k: F.struct(
        F.get(runs, k).alias("candidate"),
        F.substring_index(fields(F.concat(F.coalesce(F.get(runs, k - 1), F.lit("")), F.get(between, k))), ",", -1).alias("lead"),
        F.substring_index(fields(F.get(between, k + 1)), ",", 1).alias("tail")))
    first, last = F.col("run") == 0, F.col("run") == F.col("_n") - 1
    named = F.regexp_extract(F.concat_ws(" ", "_before2", "_before"), CREDENTIAL, 0)
    return (docs.select(column(id_col).alias("id"), column(path_col).cast("string").alias("path"), words.alias("_words"))
            .withColumn("_at", at).where(F.size("_at") > 0)
            .select("id", "path", "_words", F.explode("_at").alias("at"))
            .select("id", "path", "at", word(-2).alias("_before2"), word(-1).alias("_before"), word(1).alias("_after"),
                    F.regexp_extract_all(word(0), F.lit(f"({_TOKEN % least})"), 1).alias("_runs"),
                    F.split(word(0), _TOKEN % least, -1).alias("_between"))
            .withColumn("_found", F.filter(every, lambda c: c["candidate"].rlike("[0-9]")))
            .select("id", "path", "at", "_before2", "_before", "_after", F.size("_found").alias("_n"), F.posexplode("_found").alias("run", "_one"))
            .select("id", "path", "at", "run", "_one.candidate", F.when(first, F.col("_before2")).otherwise(named).alias("before2"),
                    F.when(first, F.col("_before")).otherwise("").alias("before"), "_one.lead", "_one.tail",
                    F.when(last, F.col("_after")).otherwise("").alias("after")))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, lower case."""
    return (docs.select(F.explode(F.split(F.lower(column(text_col).cast("string")), r"[\x20\x09-\x0D]+")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("word <> ''"))


def dictionary(counts: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more, without punctuation at their end: at most ``most``."""
    plain = F.regexp_replace("word", r"[^\p{L}]+$", "")
    rows = (counts.select(plain.alias("word"), "n").where(F.col("word").rlike(r"^\p{L}{3,}$"))
            .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most))
    return [r["word"] for r in rows.collect()]


def transitions(counts: DataFrame) -> list[float]:
    """Log probability of each pair of character kinds (letter, digit, other), by counts over all words."""
    pairs = (counts.select("word", "n").where(F.length("word") > 1)
             .select("n", F.col("word"), F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")))
    first, second = (F.substring("word", F.col("i") + k, F.lit(1)) for k in (0, 1))
    kinds = (pairs.select("n", F.instr(F.lit(_LETTERS), first).alias("a"), F.instr(F.lit(_LETTERS), second).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n")).collect())
    table = [[1.0] * _KINDS for _ in range(_KINDS)]  # at most _KINDS ** 2 rows are collected
    for r in kinds:
        table[r["a"]][r["b"]] += r["n"]
    return [math.log(v / sum(row)) for row in table for v in row]


def measured(found: DataFrame, known: list[str], table: list[float]) -> DataFrame:
    """The candidates with their features."""
    token = F.lower("candidate")
    size = F.length("candidate")
    letters = F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>")
    in_dictionary = lambda c: F.array_contains(letters, F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))).cast("double")
    runs = F.filter(F.split(token, r"[^a-z]+"), lambda r: F.length(r) >= 3)
    covered = F.aggregate(F.filter(runs, lambda r: F.array_contains(letters, r)), F.lit(0), lambda s, r: s + F.length(r))
    chance = F.array(*[F.lit(float(v)) for v in table])
    at = lambda i: F.instr(F.lit(_LETTERS), F.substring(token, i, F.lit(1)))
    steps = F.aggregate(F.sequence(F.lit(1), size - 1), F.lit(0.0), lambda s, i: s + F.get(chance, at(i) * _KINDS + at(i + 1)))
    changes = F.length(F.regexp_replace("candidate", r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", "\u0001")) - size
    context = F.concat_ws(" ", "before2", "before", F.concat("lead", "tail"))
    path = F.coalesce("path", F.lit(""))
    return found.withColumns({
        "size": size.cast("double"), "digits": F.length(F.regexp_replace("candidate", "[^0-9]", "")) / size,
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))).cast("double"), "changes": changes / size,
        "transitions": steps / F.greatest(size - 1, F.lit(1)), "coverage": covered / size,
        "path_depth": F.length(F.regexp_replace(path, "[^/]", "")).cast("double"), "path_quiet": path.rlike(QUIET).cast("double"),
        "before_known": in_dictionary(F.col("before")), "after_known": in_dictionary(F.col("after")),
        "names_credential": context.rlike(CREDENTIAL).cast("double"),
        "assigned": (F.col("before").rlike(r"[=:]$") | F.concat("lead", "candidate", "tail").rlike(r"[=:][\"']?[A-Za-z0-9+/]")).cast("double")})


def train(labelled: DataFrame, label_col: str = "label", most: int = MOST, seed: int = 5):
    """A forest over ``FEATURES``, or the share of label 1 where there is nothing to tell apart."""
    ready(labelled.sparkSession)
    order = [F.xxhash64(*FEATURES), *FEATURES]
    some = [labelled.where(F.col(label_col) == v).select(*FEATURES, F.lit(float(v)).alias("_label")).orderBy(*order).limit(most) for v in (0, 1)]
    rows = stored(some[0].unionByName(some[1]).coalesce(1).sortWithinPartitions(*order, "_label"))  # at most 2 * most short rows
    total = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(total) < 2:
        return 0.0 if 0.0 in total else 1.0
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", probabilityCol="_probability", predictionCol="_predicted",
                                    rawPredictionCol="_raw", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows))


def judged(found: DataFrame, model, cut: float = 0.5) -> DataFrame:
    """The measured candidates with probability and is_secret."""
    if isinstance(model, float):
        scored = found.withColumn("probability", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)).withColumn(
            "probability", vector_to_array("_probability")[1]).drop("_features", "_probability", "_predicted", "_raw")
    return scored.withColumn("is_secret", F.col("probability") >= cut)


def context_label() -> Column:
    """A label for findings that no one has labelled: 1 if the candidate is the quoted value of a named credential, 0 if
    nothing near it names or assigns one, else null (such findings are judged, not learned from)."""
    quoted = F.col("lead").rlike(r"(^|[=:])[\"']$") & F.col("tail").rlike(r"^[\"']")
    named = F.concat_ws(" ", "before2", "before", F.regexp_extract(F.concat("lead", "candidate", "tail"), "^(.*[=:])", 1)).rlike(CREDENTIAL)
    return F.when(quoted & named, 1).when(~quoted & ~named, 0)


def secret_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
                    labelled: DataFrame | None = None) -> DataFrame:
    """Judged candidates of all texts.

    ``labelled`` has candidates, as ``candidates`` gives them, with a 0/1 column ``label``; without it, ``context_label`` labels
    those of the texts themselves.
    """
    ready(docs.sparkSession)
    found = stored(candidates(docs, id_col, text_col, path_col))
    counts = stored(word_counts(docs, text_col))
    known, table = dictionary(counts), transitions(counts)
    ready_rows = stored(measured(found, known, table))
    learn = measured(labelled, known, table) if labelled is not None else ready_rows.withColumn("label", context_label())
    return judged(ready_rows, train(learn.where("label is not null")))
