"""Words of plain text as symbols, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII word of three characters or more that starts with a letter or _; Java's \\b would take other letters for word characters.
WORD = r"(?<![A-Za-z0-9_])([a-zA-Z_][a-zA-Z0-9_]{2,})(?![A-Za-z0-9_])"


def text_symbols(files: DataFrame) -> DataFrame:
    """files (..., content) to rows (..., line, character, name, kind): character is the word's first place in its line."""
    keep = [c for c in files.columns if c != "content"]
    lines = files.select(*keep, F.posexplode(F.split("content", "\n")).alias("line", "_s"))
    found = lines.select(*keep, "line", "_s", F.explode(F.regexp_extract_all("_s", F.lit(WORD), 1)).alias("name"))
    return found.select(*keep, "line", (F.instr("_s", F.col("name")) - 1).alias("character"), "name", F.lit("text").alias("kind"))
