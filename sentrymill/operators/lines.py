"""Files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.functions.text import raw_pieces, split_lines


def lines(files: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per line, numbered from 1.

    Matching never needs empty lines after the first; with ``keep_empty`` the
    result is exactly the lines of the file.
    """
    others = [c for c in files.columns if c != "content"]
    pieces = split_lines(F.col("content")) if keep_empty else raw_pieces(F.col("content"))
    exploded = files.select(*others, F.posexplode(pieces).alias("_pos", "line"))
    if not keep_empty:
        exploded = exploded.where((F.col("line") != "") | (F.col("_pos") == 0))
    return exploded.select(*others, (F.col("_pos") + 1).alias("line_no"), "line")
