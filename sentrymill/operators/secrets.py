"""Secret detection.  Raw values never leave the projection that finds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values.secrets import SECRET_RULES
from sentrymill.functions.suppress import suppressed
from sentrymill.functions.text import contains_any, contains_any_sql, context, regex
from sentrymill.operators.lines import lines
from sentrymill.session import literal_table, once, spread_join, sql_literal

COLUMNS = ["repo", "path", "line_no", "secret_type", "category", "severity", "matched_value", "masked_context"]


def mask(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(4)), F.lit("****"))


def _allowed(value: Column, allow_words: Sequence[str]) -> Column:
    return contains_any(F.lower(value), [w.lower() for w in allow_words]) if allow_words else F.lit(False)


def _candidate(rule: Sequence) -> str:
    return contains_any_sql("low" if rule[3].startswith("(?i") else "line", rule[5])


def _found(rules: Sequence[Sequence], allow_words: Sequence[str]) -> Column:
    """Array of (rule, value) over all rules; several values of one rule on a line all appear."""
    per_rule = ", ".join(
        f"CASE WHEN {_candidate(r)} THEN transform(regexp_extract_all(line, {sql_literal(regex(r[3]))}, {r[4]}), "
        f"v -> named_struct('rule', {i}, 'value', v)) ELSE array() END" for i, r in enumerate(rules))
    return F.filter(F.expr(f"concat({per_rule})"),
                    lambda h: (h["value"] != "") & ~_allowed(h["value"], allow_words))


def _masked(line: Column, values: Column) -> Column:
    # longest first, so that a value inside another cannot leave part of it visible
    longest = F.array_sort(F.array_distinct(values), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, line, lambda text, v: F.replace(text, v, mask(v)))


def mask_lines(df: DataFrame, column: str, rules: Sequence[Sequence] = SECRET_RULES) -> DataFrame:
    """``df`` with every value any secret rule finds in ``column`` replaced by its mask."""
    keep = [F.col(c) for c in df.columns]
    values = F.transform("_found", lambda h: h["value"])
    found = (df.select(*keep, F.col(column).alias("line"), F.lower(column).alias("low"))
             .select(*keep, once(_found(rules, ())).alias("_found")))
    return found.withColumn(column, F.when(F.size("_found") > 0, _masked(F.col(column), values))
                            .otherwise(F.col(column))).drop("_found")


def secret_findings(files: DataFrame, rules: Sequence[Sequence] = SECRET_RULES, allow_words: Sequence[str] = (),
                    extra: Sequence[str] = (), keyed: bool = False, salt: str = "") -> DataFrame:
    """All distinct (rule, value) pairs per line, masked.

    ``extra`` carries columns of ``files`` through (a commit, say).  With
    ``keyed`` a salted hash of the raw value is added for comparing findings
    whose masks may collide.
    """
    any_rule = F.expr(" OR ".join(_candidate(rule) for rule in rules))
    candidates = lines(
        files.select("repo", "path", *extra, "content")).withColumn("low", F.lower("line")).where(any_rule)
    found = candidates.select("*", once(_found(rules, allow_words)).alias("found"))
    live = found.where((F.size("found") > 0) & ~suppressed(F.col("line"), "secret"))
    masked = live.select(
        "repo", "path", *extra, "line_no",
        context(_masked(F.col("line"), F.transform("found", lambda h: h["value"]))).alias("masked_context"),
        F.inline(F.array_distinct(F.transform("found", lambda h: F.struct(
            h["rule"].alias("rule"), mask(h["value"]).alias("matched_value"),
            F.sha2(F.concat(F.lit(salt), h["value"]), 256).alias("value_key"))))))
    dimension = literal_table(files.sparkSession, ["rule", "secret_type", "category", "severity"],
                              [(i, r[0], r[1], r[2]) for i, r in enumerate(rules)])
    named = masked.join(F.broadcast(dimension), "rule")
    return named.select(*COLUMNS, *extra, *(["value_key"] if keyed else []))


def history_findings(versions: DataFrame, current: DataFrame, salt: str = "") -> DataFrame:
    """Secrets of past versions that are no longer in the working tree.

    Compared on (repo, path, type, keyed value): masks of two secrets can be
    equal, their keys are not.
    """
    past = secret_findings(versions, extra=("commit",), keyed=True, salt=salt)
    now = (secret_findings(current, keyed=True, salt=salt)
           .select("repo", "path", "secret_type", "value_key").distinct())
    gone = spread_join(past, now, ["repo", "path", "secret_type", "value_key"], "left_anti")
    return gone.drop("value_key")
