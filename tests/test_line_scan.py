"""One pass over the lines for rules and secrets, and rule sets of any size."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrymill.fixed_values.secrets import SECRET_RULES
from sentrymill.functions import fragments
from sentrymill.operators import classify, line_scan, match, secrets
from sentrymill.plans import scan
from workloads import planted


def tree():
    out = {}
    for suffix, texts in ((".py", planted.CODE), (".tf", planted.IAC), ("/Dockerfile", planted.DOCKER)):
        for i, text in enumerate(texts):
            out[f"d{i}{suffix}"] = f"first line\n{text}\n\nlast {text}"
    out |= {f".github/workflows/w{i}.yml": text for i, text in enumerate(planted.WORKFLOW)}
    out |= {f"notes{i}.txt": text for i, text in enumerate(planted.CODE)}  # secrets only
    out |= {"node_modules/a.py": "eval(x)", "empty.py": "", "Dockerfile": "FROM a:1", "x.dockerfile": f'ENV KEY="{planted.AWS}"  # nosec code',
            "two.py": f'eval("{planted.AWS}"); k = "{planted.AWS2}"', "quiet.py": f'eval("{planted.AWS}")  # nosec secret',
            "nothing.py": f'eval("{planted.AWS}")  # nosec'}
    return out


def test_one_pass_equals_both(spark, make_files):
    files = make_files(tree()).unionByName(spark.createDataFrame([("r", "null.py", None), ("r", None, "eval(x)"), (None, "a.py", "eval(x)")],
                                                                 "repo string, path string, content string"))
    got = line_scan.tagged_findings(files)
    code = match.line_findings(classify.classified(files)).select(F.lit("code").alias("phase"), *match.FINDING, F.lit(None).alias("matched_value"))
    secret = secrets.secret_findings(files.where(~classify.skipped_for_code(F.col("path")))).select(
        F.lit("secrets").alias("phase"), "repo", "path", "line_no", F.col("secret_type").alias("issue_type"), "category", "severity",
        F.lit(None).cast("string").alias("description"), F.col("masked_context").alias("context"), "matched_value")
    want = code.unionByName(secret).select(*got.columns)
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {r.phase for r in got.collect()} == {"code", "secrets"}


def test_a_scan_splits_lines_once(make_files):
    files = make_files(tree())
    text = scan.scan(files, ("secrets", "code"), use_default_ignores=False, ignore_file=None)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("posexplode") == 1
    assert text.count("regexp_extract_all") == len(SECRET_RULES)
    for pattern in (r"\bos\.system\s*\(", r"marshal\.loads?\s*\("):
        assert text.count(pattern) <= 1, pattern


def test_no_rules(spark, make_files):
    files = make_files({"a.py": f'eval("{planted.AWS}")'})
    assert [r.phase for r in line_scan.tagged_findings(files, rule_sets={}).collect()] == ["secrets"]
    assert line_scan.indexed_findings(files, []).count() == 0
    empty = make_files({"a.py": "x"}).where("false")
    assert line_scan.tagged_findings(empty).count() == 0 and line_scan.indexed_findings(empty, [("A", "c", "LOW", "x", "t", ("x",))]).count() == 0


WORDS = st.text("abc.+", min_size=1, max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.sets(WORDS, min_size=1, max_size=12), st.text("abc.+x", max_size=30))
def test_every_fragment_is_found(parts, text):
    begin = fragments.beginnings(parts)
    found = {f for m in re.finditer(fragments.every_regex(parts), text) for f in begin[m.group(1)]}
    assert found == {p for p in parts if p in text}


def _by_hand(rules, line):
    return next((r[0] for r in rules if re.search(r[3], line)), None)


def test_indexed_rules_equal_a_chain(spark, make_files):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdE") for _ in range(n))
    rules = []
    for i in range(300):
        part = word(rng.randint(2, 4))
        pattern, needs = rng.choice([(part + "[0-9]+", (part,)), ("(?i)" + part + "[a-c]?;", (part.lower(),)), (part + "|" + part[::-1], (part, part[::-1])),
                                     ("é" + part, ("é" + part,))])
        rules.append((f"Rule {i}", "x", "LOW", pattern, "text", needs))
    rules.append(("No fragment", "x", "HIGH", r"^\d{5}$", "text", ()))
    texts = ["", "12345", "é" + rules[7][5][0]] + [" ".join(word(rng.randint(1, 9)) + rng.choice(["", "1", ";", "é"]) for _ in range(4)) for _ in range(300)]
    found = line_scan.indexed_findings(make_files({"a.txt": "\n".join(texts)}), rules)
    assert {(r.line_no, r.issue_type) for r in found.collect()} == {(i, _by_hand(rules, t)) for i, t in enumerate(texts, 1) if _by_hand(rules, t)}
    hushed = line_scan.indexed_findings(make_files({"a.txt": "12345", "b.txt": rules[0][5][0] + "1  # nosec"}), rules)
    assert [r.path for r in hushed.collect()] == ["a.txt"]


def test_rules_stand_in_the_plan_once_however_many(make_files):
    rules = [(f"R{i}", "x", "LOW", rf"\bname{i}\b", "text", (f"name{i}",)) for i in range(1000)]
    found = line_scan.indexed_findings(make_files({"a.py": "name77 name5\nname999\nnone"}), rules)
    text = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert text.count("rlike") <= 2 + text.count("nosec")  # rules are data: no branch for each
    assert {(r.line_no, r.issue_type) for r in found.collect()} == {(1, "R5"), (2, "R999")}
