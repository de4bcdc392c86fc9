from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrymill.functions.suppress import scopes, suppressed
from sentrymill.functions.text import SPACE, decode, split_lines, strip
from sentrymill.operators.lines import lines

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def test_space_is_pythons():
    assert set(SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "", " x", *BREAKS]), max_size=8), min_size=20, max_size=40))
def test_split_lines_like_python(spark, pieces):
    texts = ["".join(p) for p in pieces]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", split_lines(F.col("t")).alias("x")).collect()}
    assert got == {i: t.splitlines() for i, t in enumerate(texts)}


def test_line_numbers(spark, make_files):
    text = "a\r\nb\n\nc\x0bd\u2028e\n"
    files = make_files({"x.py": text})
    assert [(r.line_no, r.line) for r in lines(files, keep_empty=True).orderBy("line_no").collect()] == list(
        enumerate(text.splitlines(), 1))
    assert lines(make_files({"x.py": ""}), keep_empty=True).count() == 0


def test_decode_and_strip(spark):
    raw = [b"plain", b"\xff\xfe", b"a\xc3(", b"\xe2\x82", b"\xed\xa0\x80x", b"\xf0\x9f\x98\x80"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", decode(F.col("b")).alias("t")).collect()}
    assert got == {i: b.decode("utf-8", "replace") for i, b in enumerate(raw)}
    odd = ["\u00a0 x\u2003", "\t\x1fy\x85", "z"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.s for r in df.select(strip(F.col("t")).alias("s")).collect()] == [t.strip() for t in odd]


def test_suppression_scopes(spark):
    cases = {
        "x = 1": None, "x = 1  # nosec": [], "x = 1  # nosec code": ["code"], "x = 1  // nosec secret": ["secret"],
        "k  # NOSEC: secrets, deps": ["secret", "dep"], "k  # nosec because code is fine": ["code"],
        "k  <!-- nosec dependency": ["dep"], "k nosec": None, "k  # nosecrets": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.s for r in df.select("t", scopes(F.col("t")).alias("s")).collect()}
    assert {k: v and sorted(v) for k, v in got.items()} == {k: v and sorted(v) for k, v in cases.items()}
    flags = df.select("t", suppressed(F.col("t"), "secret").alias("s")).collect()
    assert {r.t: r.s for r in flags} == {k: v is not None and (not v or "secret" in v) for k, v in cases.items()}
