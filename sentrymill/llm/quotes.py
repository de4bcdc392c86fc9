"""Quotation linking: who quotes whom, and conversations in reply order without the quotes.

Built-in expressions only.  A line that starts with n signs ``>`` is quoted n levels deep; neighbouring lines of one level are a
passage.  A passage and each of its lines are normalised (blanks collapsed, lower case) and hashed; so are every message's own text,
own passages and own lines.  A passage that equals a whole own text or own passage links at any length; single lines link from ``least``
normalised code points on, as short ones are found in many messages.  Equal hashes within a conversation link a quoted passage to the
first message that holds it itself, if that is an earlier one; of several, the one with the most quoted characters counts, then the latest.

A message replies to the message that its first-level passages quote, else to the one before it.  Depths come from
pointer doubling over these links (a chain of n replies takes log n rounds).  The reply order of a conversation is by depth, then
place.  Places and positions are counted over ranges (``numbered``), so a long conversation is not one task.

Defined cases: null and empty texts quote nothing and are never quoted; a null conversation id makes a row a conversation of its own; a
null turn comes first; repeated rows are messages of their own, in any order among themselves; result columns replace columns of their
name; other columns pass through; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import column, others, own_name, ready, stored
from sentrymill.session import numbered

#: Normalised code points from which a single line is distinctive enough to link by.
LEAST = 12
_MARK = r"^[ \t]*((?:>[ \t]?)+)"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), r"[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(text: Column) -> Column:
    """Array of (level, lines) in the text's order; the lines without quote signs."""
    parted = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"),
                         lambda line: F.struct(level_of(line).alias("level"), F.regexp_replace(line, _MARK, "").alias("line")))
    lines = F.col("_lines")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                      lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    runs = F.transform(F.col("_starts"), lambda s, k: F.struct(
        F.get(lines, s)["level"].alias("level"),
        F.slice(lines["line"], s + 1, F.coalesce(F.get(F.col("_starts"), k + 1), F.size(lines)) - s).alias("lines")))
    return parted, starts, runs


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``_runs``, the passages of the text."""
    parted, starts, runs = passages(column(text_col).cast("string"))
    # the line break before a quoted run belongs to neither side
    return (messages.withColumn("_lines", parted).withColumn("_starts", starts).withColumn("_runs", runs).drop("_lines", "_starts"))


def own_text(runs: Column) -> Column:
    """The text without quoted lines, blank lines at its ends dropped."""
    mine = F.filter(runs, lambda r: r["level"] == 0)
    return F.regexp_replace(F.array_join(F.flatten(F.transform(mine, lambda r: r["lines"])), "\n"), r"^\s*\n|\s+$", "")


def _units(wholes: Column, least: int) -> Column:
    """Normalised texts worth linking, of an array of arrays of lines: all lines of each together, and each line of ``least``."""
    joined = F.transform(wholes, lambda lines: normalised(F.array_join(lines, " ")))
    single = F.filter(F.transform(F.flatten(wholes), normalised), lambda t: F.length(t) >= least)
    return F.filter(F.array_distinct(F.concat(joined, single)), lambda t: t != "")


def links(placed: DataFrame, least: int = LEAST) -> DataFrame:
    """(_conv, _place, passage, level, original): each quoted passage whose original is known."""
    mine = F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["lines"])
    # own text as a whole, own passages, own lines; the first place that holds a unit stands for it
    held = (placed.select("_conv", "_place", F.explode(_units(F.concat(F.array(F.flatten(mine)), mine), least)).alias("unit"))
            .groupBy("_conv", F.xxhash64("unit").alias("hash"), F.xxhash64(F.reverse("unit")).alias("hash2"))
            .agg(F.min("_place").alias("original")))
    quoted = (placed.where(F.exists("_runs", lambda r: r["level"] > 0))
              .select("_conv", "_place", F.posexplode("_runs").alias("passage", "run")).where("run.level > 0")
              .select("_conv", "_place", "passage", F.col("run.level").alias("level"), F.explode(_units(F.array("run.lines"), least)).alias("unit"))
              .select("_conv", "_place", "passage", "level", F.length("unit").alias("size"),
                      F.xxhash64("unit").alias("hash"), F.xxhash64(F.reverse("unit")).alias("hash2")))
    found = quoted.join(held, ["_conv", "hash", "hash2"]).where("original < _place")
    votes = found.groupBy("_conv", "_place", "passage", "level", "original").agg(F.sum("size").alias("size"))
    best = votes.groupBy("_conv", "_place", "passage", "level").agg(F.max(F.struct("size", "original")).alias("best"))
    return best.select("_conv", "_place", "passage", "level", F.col("best.original").alias("original"), F.col("best.size").alias("size"))


def depths(parents: DataFrame) -> DataFrame:
    """(_conv, _place, depth) from (_conv, _place, parent): a message without parent has depth 0."""
    now = stored(parents.select("_conv", "_place", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while not now.where("up is not null").isEmpty():
        # messages that have reached their first ancestor are looked up, but look for nothing more
        above = now.select(F.col("_conv").alias("_c"), F.col("_place").alias("_p"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = (now.where("up is not null").join(above, (F.col("_conv") == F.col("_c")) & (F.col("up") == F.col("_p")))
                 .select("_conv", "_place", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth")))
        now = stored(now.where("up is null").unionByName(moved))
    return now.select("_conv", "_place", "depth")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text",
                  least: int = LEAST) -> DataFrame:
    """All rows and columns; own_text, place (by turn, from 0), parent (the place replied to), depth, position (in reply order),
    quote_levels (deepest level), n_linked (quoted passages whose original is known).  Single lines
    of fewer than ``least`` normalised code points link nothing by themselves."""
    ready(messages.sparkSession)
    results = ["own_text", "place", "parent", "depth", "position", "quote_levels", "n_linked"]
    given = others(messages, *results)
    body = own_name(messages, "_body")
    rows = messages.select(F.struct(*[column(c) for c in given]).alias(body), column(conv_col).cast("long").alias("_conv"),
                           column(turn_col).cast("long").alias("_turn"), column(text_col).cast("string").alias("_text"))
    known = rows.where("_conv is not null").withColumn("_tie", F.xxhash64("_text"))
    # only numbers and hashes are range-partitioned twice; texts once
    placed = stored(parsed(numbered(known, ["_conv"], ["_turn", "_tie"], "_place"), "_text"))
    linked = stored(links(placed, least))
    answered = (linked.where("level = 1").groupBy("_conv", "_place", "original").agg(F.sum("size").alias("size"))
                .groupBy("_conv", "_place").agg(F.max(F.struct("size", "original")).alias("_best"))
                .select("_conv", "_place", F.col("_best.original").alias("original")))
    counted = linked.groupBy("_conv", "_place").agg(F.count(F.lit(1)).alias("n_linked"))
    parents = stored(placed.select("_conv", "_place").join(answered, ["_conv", "_place"], "left").join(counted, ["_conv", "_place"], "left")
                     .select("_conv", "_place", F.coalesce("original", F.when(F.col("_place") > 0, F.col("_place") - 1)).alias("parent"),
                             F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked")))
    ordered = numbered(parents.join(depths(parents), ["_conv", "_place"]), ["_conv"], ["depth", "_place"], "position")
    deepest = F.coalesce(F.array_max(F.transform("_runs", lambda r: r["level"])), F.lit(0))
    out = [F.col(f"{body}.`{c}`").alias(c) for c in given]
    done = placed.join(ordered, ["_conv", "_place"]).select(
        *out, own_text(F.col("_runs")).alias("own_text"), F.col("_place").alias("place"), "parent", "depth", "position",
        deepest.alias("quote_levels"), "n_linked")
    alone = parsed(rows.where("_conv is null"), "_text").select(
        *out, own_text(F.col("_runs")).alias("own_text"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("parent"),
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position"), deepest.alias("quote_levels"),
        F.lit(0).cast("long").alias("n_linked"))
    return done.unionByName(alone)


def with_quotes(messages: DataFrame) -> DataFrame:
    """Conversations as mail would carry them: each message quotes the one before, and that one's first line of its own quote.

    ``messages`` has conv_id, turn, role, text; tables of plain turns hold no quotes of their own.
    """
    said = (messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said")))
    one = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("_one"))
    two = said.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("said").alias("_two"))
    quoted = F.concat_ws(
        "\n", F.when(F.length("_two") > 0, F.concat(F.lit(">> "), F.split("_two", "\n")[0])),
        F.when(F.length("_one") > 0, F.array_join(F.transform(F.split("_one", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")))
    return (messages.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", F.concat_ws("\n", F.when(F.length(quoted) > 0, quoted), "text").alias("text")))
