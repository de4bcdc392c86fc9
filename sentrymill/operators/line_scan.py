"""Line rules and secrets in one pass over the text, and rule sets of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values import rules as R
from sentrymill.fixed_values.secrets import SECRET_RULES
from sentrymill.functions import fragments
from sentrymill.functions.suppress import scopes, suppressed
from sentrymill.functions.text import context, regex
from sentrymill.operators import classify, match, secrets
from sentrymill.operators.lines import lines
from sentrymill.session import literal_table, once, sql_literal

TAGGED = ["repo", "path", "line_no", "phase", "issue_type", "category", "severity", "description", "context", "matched_value"]
SECRET = -1  # the mark of a line that may hold a secret


def tagged_findings(files: DataFrame, rule_sets: dict[str, Sequence[Sequence]] = match.RULE_SETS,
                    secret_rules: Sequence[Sequence] = SECRET_RULES) -> DataFrame:
    """The rows of ``match.line_findings`` and of ``secrets.secret_findings``, told apart by ``phase``: files are split once.

    A line gets marks, the numbers of its matched rules and one for a possible secret.  Lines without marks go before
    anything else is computed; the values of secrets are looked for once a line and serve its findings and its masked context.
    Only files outside the skipped directories take part.
    """
    path, kind = F.col("path"), F.col("file_kind")
    no_user = F.coalesce((kind == "dockerfile") & ~F.col("content").rlike("(?Ud)" + R.DOCKER_ABSENCE_RULE[3]), F.lit(False))
    shown = (files.where(~classify.skipped_for_code(path)).withColumn("file_kind", classify.file_kind(path))
             .select("repo", "path", "file_kind", no_user.alias("no_user"), "content"))
    rules, branches = [], []
    for name, members in rule_sets.items():
        branches.append(f"WHEN file_kind = {sql_literal(name)} THEN {match._matched(name, members, len(rules))}")
        rules.extend(members)
    ruled = f"CASE {' '.join(branches)} ELSE array(CAST(NULL AS INT)) END" if branches else "array(CAST(NULL AS INT))"
    maybe = " OR ".join(secrets._candidate(r) for r in secret_rules) or "false"
    marks = F.expr(f"array_compact(concat({ruled}, array(CASE WHEN {maybe} THEN {SECRET} END)))")
    marked = (lines(shown).withColumn("low", F.lower("line"))
              .select("repo", "path", "line_no", "line", "low", once(marks).alias("marks")).where(F.size("marks") > 0))
    whole_file = F.array(*[F.lit(i) for i, r in enumerate(rules) if r is R.DOCKER_ABSENCE_RULE]).cast("array<int>")
    # a scope list is empty where all scopes are meant
    hushed = marked.withColumn("_scopes", scopes(F.col("line")))
    silent = [F.coalesce((F.size("_scopes") == 0) | F.array_contains("_scopes", s), F.lit(False)) & F.col("_scopes").isNotNull()
              for s in ("code", "secret")]
    live = hushed.select("*", silent[0].alias("_no_code"), silent[1].alias("_no_secret")).withColumn(
        "live", F.filter("marks", lambda m: F.array_contains(whole_file, m) | F.when(m == SECRET, ~F.col("_no_secret"))
                         .otherwise(~F.col("_no_code")))).where(F.size("live") > 0)
    found = live.select("repo", "path", "line_no", "line", "live", once(secrets._found(secret_rules, ())).alias("found"))
    secret = F.when(F.array_contains("live", SECRET), F.transform(F.array_distinct("found"), lambda h: F.struct(
        (h["rule"] + len(rules)).cast("int").alias("rule"), secrets.mask(h["value"]).alias("matched_value"))))
    code = F.transform(F.filter("live", lambda m: m != SECRET), lambda m: F.struct(
        m.alias("rule"), F.lit(None).cast("string").alias("matched_value")))
    every = F.concat(code, F.coalesce(secret, F.array().cast("array<struct<rule:int,matched_value:string>>")))
    rows = found.select("repo", "path", "line_no", context(secrets._masked(F.col("line"), F.transform("found", lambda h: h["value"])))
                        .alias("context"), F.inline(every))
    table = literal_table(files.sparkSession, ["rule", "phase", "issue_type", "category", "severity", "description"],
                          [(i, "code", r[0], r[1], r[2], r[4]) for i, r in enumerate(rules)]
                          + [(len(rules) + i, "secrets", r[0], r[1], r[2], None) for i, r in enumerate(secret_rules)])
    return rows.join(F.broadcast(table), "rule").select(*TAGGED)


def indexed_findings(files: DataFrame, rules: Sequence[Sequence], scope: str = "code") -> DataFrame:
    """First matching rule of each line, for rule sets of thousands.

    One expression gives the fragments that stand in a line, an index leads from each to its rules, and only
    those rules are tested, in order of precedence: the time of a line follows the rules whose fragments it holds, not
    the size of the rule set.  Rules without a fragment, or with one that is not ASCII, are tested on every line.
    The index and the rule table are as large as the rule set that the caller gives.
    ``files``: repo, path, content; files of all kinds and folders take part.
    """
    always = [i for i, r in enumerate(rules) if not r[5] or not all(f and f.isascii() for f in r[5])]
    # lower case throughout: a fragment found so may still be absent as written, which the rule itself decides
    by_fragment: dict[str, set[int]] = {}
    for i, r in enumerate(rules):
        if i not in always:
            for f in r[5]:
                by_fragment.setdefault(f.lower(), set()).add(i)
    cut = lines(files.select("repo", "path", "content")).withColumn("low", F.lower("line"))
    wanted = F.lit(always).cast("array<int>") if always else F.array().cast("array<int>")
    if by_fragment:
        leads = {f: sorted(set().union(*(by_fragment[b] for b in firsts))) for f, firsts in fragments.beginnings(by_fragment).items()}
        names = ", ".join(sql_literal(f) for f in leads)
        numbers = ", ".join(f"array({', '.join(map(str, ids))})" for ids in leads.values())
        index = F.expr(f"map_from_arrays(array({names}), array({numbers}))")
        held = F.array_distinct(F.expr(f"regexp_extract_all(low, {sql_literal(fragments.every_regex(by_fragment))}, 1)"))
        wanted = F.concat(wanted, F.flatten(F.transform(held, lambda f: F.element_at(index, f))))
    candidates = cut.select("repo", "path", "line_no", "line", once(F.array_sort(F.array_distinct(wanted))).alias("_rules"))
    patterns = F.expr(f"array({', '.join(sql_literal(regex(r[3])) for r in rules)})") if rules else F.array().cast("array<string>")
    first = F.get(F.filter("_rules", lambda r: F.rlike(F.col("line"), F.get(patterns, r))), F.lit(0))
    hit = (candidates.where(F.size("_rules") > 0).select("repo", "path", "line_no", "line", once(first).alias("rule"))
           .where(F.col("rule").isNotNull() & ~suppressed(F.col("line"), scope)))
    table = literal_table(files.sparkSession, match.RULE_COLUMNS, [(i, r[0], r[1], r[2], r[4]) for i, r in enumerate(rules)] or [(-1,) + ("",) * 4])
    named = hit.join(F.broadcast(table), "rule").withColumnRenamed("line", "shown")
    return secrets.mask_lines(named, "shown").withColumn("context", context(F.col("shown"))).select(*match.FINDING)
