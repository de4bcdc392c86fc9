"""Rules against lines and files.

Rules become one column expression per rule set, so a line is tested inside a
single projection.  Each rule tests a literal fragment before its regular
expression; prose lines rarely reach the expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values import rules as R
from sentrymill.functions.suppress import suppressed
from sentrymill.functions.text import contains_any_sql, context, regex
from sentrymill.operators.lines import lines
from sentrymill.operators.secrets import mask_lines
from sentrymill.session import literal_table, sql_literal

RULE_COLUMNS = ["rule", "issue_type", "category", "severity", "description"]
# file kind -> its rules, in order of precedence
RULE_SETS = {"code": R.CODE_RULES, "iac": R.IAC_RULES, "workflow": R.WORKFLOW_RULES,
             "dockerfile": [R.DOCKER_ABSENCE_RULE, *R.DOCKER_RULES]}
COMMENTED = ("iac", "workflow")  # kinds in which a line starting with # is skipped
FINDING = ["repo", "path", "line_no", "issue_type", "category", "severity", "description", "context"]


def hits(rule: Sequence) -> str:
    """SQL condition over ``line`` and its lower-cased form ``low``.

    Rule sets are long; as text they reach the JVM in one call.
    """
    pattern, needs = rule[3], rule[5]
    found = f"line RLIKE {sql_literal(regex(pattern))}"
    if needs:
        found = f"{contains_any_sql('low' if pattern.startswith('(?i') else 'line', needs)} AND {found}"
    return found



def _first(rules: Sequence[Sequence], start: int) -> str:
    chain = " ".join(f"WHEN {hits(r)} THEN {i}" for i, r in enumerate(rules, start))
    return f"CASE {chain} END"


def _matched(kind: str, rules: Sequence[Sequence], start: int) -> str:
    """SQL array of matched rule numbers of one line (nulls where nothing matched)."""
    if kind == "dockerfile":  # every rule counts; the whole-file rule is reported on line 1
        each = [f"CASE WHEN {'line_no = 1 AND no_user' if r is R.DOCKER_ABSENCE_RULE else hits(r)} THEN {i} END"
                for i, r in enumerate(rules, start)]
        return f"array({', '.join(each)})"
    first = _first(rules, start)
    if kind in COMMENTED:
        comment = sql_literal(regex(r"\A\s*#"))
        first = f"CASE WHEN NOT line RLIKE {comment} THEN {first} END"
    return f"array({first})"


def line_findings(files: DataFrame, rule_sets: dict[str, Sequence[Sequence]] = RULE_SETS) -> DataFrame:
    """Findings of all given file kinds in one pass over the text.

    A line of code, IaC or workflow takes the first rule that matches, a
    Dockerfile line all of them.  Each kind's rules stand in one branch of one
    expression, evaluated once per line inside the generator.
    """
    kind = F.col("file_kind")
    # (?d): only \n ends a line for ^, as in Python
    no_user = (kind == "dockerfile") & ~F.col("content").rlike("(?Ud)" + R.DOCKER_ABSENCE_RULE[3])
    wanted = files.where(kind.isin(list(rule_sets))).select("repo", "path", kind, no_user.alias("no_user"), "content")
    rules, branches = [], []
    for name, members in rule_sets.items():
        branches.append(f"WHEN file_kind = {sql_literal(name)} THEN {_matched(name, members, len(rules))}")
        rules.extend(members)
    matched = lines(wanted).withColumn("low", F.lower("line")).select(
        "repo", "path", "line_no", "line", F.explode(F.expr(f"CASE {' '.join(branches)} END")).alias("rule"))
    whole_file = [i for i, r in enumerate(rules) if r is R.DOCKER_ABSENCE_RULE]
    kept = matched.where(F.col("rule").isNotNull()
                         & (F.col("rule").isin(whole_file) | ~suppressed(F.col("line"), "code")))
    table = literal_table(files.sparkSession, RULE_COLUMNS,
                          [(i, r[0], r[1], r[2], r[4]) for i, r in enumerate(rules)])
    # the line is masked before it is cut: half a secret at the cut would match no rule
    named = kept.join(F.broadcast(table), "rule").withColumnRenamed("line", "shown")
    return mask_lines(named, "shown").withColumn("context", context(F.col("shown"))).select(*FINDING)


def code_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, {"code": RULE_SETS["code"]})


def iac_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, {"iac": RULE_SETS["iac"]})


def workflow_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, {"workflow": RULE_SETS["workflow"]})


def docker_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, {"dockerfile": RULE_SETS["dockerfile"]})
