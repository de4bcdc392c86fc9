"""One comparable key per version: keys of an ecosystem compare, as strings, as the ecosystem orders its versions.

A key is a row of parts.  A number is its count of digits, then its digits, so longer numbers are larger.  After the release numbers, whose
trailing zeros do not count, comes a mark: below END stands what precedes the release, above it what follows, and above all of
these another release number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.session import let

BEFORE, END, AFTER, NUMBER = "3", "5", "7", "n"
STOP = "!"  # ends a word; less than any character of one

# Words for the stages of a release, in their order.
PYTHON_STAGES = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "r", "rc": "r", "pre": "r", "preview": "r"}
COMPOSER_STAGES = {"dev": "30", "alpha": "31", "a": "31", "beta": "32", "b": "32", "rc": "33", "patch": "7", "pl": "7", "p": "7"}
MAVEN_STAGES = {"alpha": "31", "a": "31", "beta": "32", "b": "32", "milestone": "33", "m": "33", "rc": "34", "cr": "34", "snapshot": "35", "sp": "70"}
MAVEN_RELEASES = "ga|final|release"
# Fixed value: a Python version: epoch, release, stage, its number, post release (two forms), development release, local part.
PYTHON = (r"\Av?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
          r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\z")
#: Any other version: what is in front of the first number, the release, a pre-release with or without a hyphen, build data.
PLAIN = r"(?s)\A[^\d]*(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+)|([A-Za-z][0-9A-Za-z.-]*))?.*\z"
_CUT = "\x01"


def number(digits: Column) -> Column:
    """Any row of digits, in the order of the numbers; none is 0."""
    def of(bare: Column) -> Column:
        return F.concat(F.lpad(F.length(bare).cast("string"), 4, "0"), bare)

    return let(F.regexp_replace(F.concat(F.lit("0"), digits), r"\A0+(?=\d)", ""), of)


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern, found at once; fewer entries where it does not match."""
    return F.split(F.regexp_replace(text, pattern, _CUT.join(f"${i}" for i in range(1, groups + 1))), _CUT, -1)


def _each(text: Column, pattern: str, encoded: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), encoded), "")


def _release(numbers: Column) -> Column:
    return _each(F.regexp_replace(numbers, r"(?:\.0+)+\z", ""), r"\d+", lambda x: F.concat(F.lit(NUMBER), number(x)))


def _named(word: Column, names: dict[str, str], other: Column) -> Column:
    for name, value in names.items():
        other = F.when(word == name, value).otherwise(other)
    return other


def python_key(version: Column) -> Column:
    """Epoch, release, stage, post, development and local part; null for what is no such version.

    A development release stands before all stages, and a stage before the release; local parts follow what they are part of.
    """
    def key(p: Column) -> Column:
        epoch, release, stage, step, bare_post, post, post_step, dev, dev_step, local = (F.get(p, F.lit(i)) for i in range(10))
        has_post = (bare_post != "") | (post != "")
        before = (F.when(stage != "", F.concat(F.lit(BEFORE), _named(stage, PYTHON_STAGES, F.lit("")), number(step)))
                  .when((dev != "") & ~has_post, "1").otherwise(END))
        after = F.when(has_post, F.concat(F.lit("1"), number(F.concat(bare_post, post_step)))).otherwise("0")
        under = F.when(dev != "", F.concat(F.lit("0"), number(dev_step))).otherwise("9")
        part = _each(local, "[a-z0-9]+", lambda x: F.when(x.rlike(r"\A\d+\z"), F.concat(F.lit("b"), number(x)))
                     .otherwise(F.concat(F.lit("a"), x, F.lit(STOP))))
        return F.when(F.size(p) == 10, F.concat(number(epoch), _release(release), before, after, under, part, F.lit("0")))

    return let(_parts(F.lower(F.trim(version)), PYTHON, 10), key)


def plain_key(version: Column) -> Column:
    """Semantic versions, also with fewer or more numbers: pre-release identifiers by number, numbers before words, fewer before more;
    build data does not count.  Revisions without a tag are pre-releases whose identifiers hold their time."""
    def key(p: Column) -> Column:
        stage = F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(2)))
        names = _each(stage, r"[^.]+", lambda x: F.when(x.rlike(r"\A\d+\z"), F.concat(F.lit("1"), number(x)))
                      .otherwise(F.concat(F.lit("2"), x, F.lit(STOP))))
        ending = F.when(stage == "", END).otherwise(F.concat(F.lit(BEFORE), names, F.lit("0")))
        return F.when(F.size(p) == 3, F.concat(_release(F.get(p, F.lit(0))), ending)).otherwise("")

    return let(_parts(F.regexp_replace(F.trim(version), r"(?s)\+.*", ""), PLAIN, 3), key)


def ruby_key(version: Column) -> Column:
    """Numbers and words; a word stands before the end, so before the release, and the end before a number; a hyphen starts ``pre``."""
    text = F.regexp_replace(F.trim(version), "-", ".pre.")
    text = F.regexp_replace(text, r"(?:\.0+)+(?=\z|\.?[A-Za-z])", "")
    tokens = _each(text, r"\d+|[A-Za-z]+", lambda x: F.when(x.rlike(r"\A\d"), F.concat(F.lit(NUMBER), number(x)))
                   .otherwise(F.concat(F.lit(BEFORE), x, F.lit(STOP))))
    return F.when(version.rlike(r"\d"), F.concat(tokens, F.lit(END))).otherwise("")


def composer_key(version: Column) -> Column:
    """Numbers, then dev, alpha, beta, RC, the release, or a patch of it."""
    def key(p: Column) -> Column:
        stage = F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(2)))
        word = F.regexp_extract(stage, r"\A([a-z]+)", 1)
        mark = _named(word, COMPOSER_STAGES, F.lit("30"))
        ending = F.when(stage == "", END).otherwise(F.concat(mark, number(F.regexp_extract(stage, r"\A[a-z]+[.-]?(\d+)", 1))))
        return F.when(F.size(p) == 3, F.concat(_release(F.get(p, F.lit(0))), ending)).otherwise("")

    return let(_parts(F.regexp_replace(F.lower(F.trim(version)), r"(?s)\+.*", ""), PLAIN, 3), key)


def maven_key(version: Column) -> Column:
    """Numbers and qualifiers: alpha, beta, milestone, rc, snapshot, the release, sp, other words by letter, numbers behind a hyphen,
    numbers behind a dot."""
    text = F.regexp_replace(F.lower(F.trim(version)), r"(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", "-")
    text = F.regexp_replace(text, rf"[.-](?:{MAVEN_RELEASES})(?=\z|[.-])", "")
    text = F.regexp_replace(text, r"(?:[.-]0+)+(?=\z|-)", "")

    def token(x: Column) -> Column:
        word = F.regexp_extract(x, r"([a-z]+)", 1)
        digits = F.concat(F.when(F.startswith(x, F.lit("-")), "m").otherwise(NUMBER), number(F.regexp_extract(x, r"(\d+)", 1)))
        return F.when(word == "", digits).otherwise(_named(word, MAVEN_STAGES, F.concat(F.lit("71"), word, F.lit(STOP))))

    return F.when(version.rlike(r"\d"), F.concat(_each(text, r"[.-]?(?:\d+|[a-z]+)", token), F.lit(END))).otherwise("")


def order_key(ecosystem: Column, version: Column) -> Column:
    """The key of a version among those of its ecosystem; null for null.  What is no version of it at all comes first."""
    return (F.when(version.isNull(), F.lit(None).cast("string"))
            .when(ecosystem == "PyPI", F.coalesce(python_key(version), F.lit("")))
            .when(ecosystem == "RubyGems", ruby_key(version))
            .when(ecosystem == "Packagist", composer_key(version))
            .when(ecosystem == "Maven", maven_key(version))
            .otherwise(plain_key(version)))
