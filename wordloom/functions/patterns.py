"""Patterns in a small word notation, compiled for Spark (Java) and for DuckDB (RE2, no look-around).

A leading `=` makes a pattern case-sensitive. `<` and `>` stand for a word's start and end, `_` for the white space between two words. Spark gets
look-arounds over letters, digits and underscores. RE2 has none, so the SQL twin marks each word's
start and end with control characters first and matches those; offsets don't count the marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDCHAR = r"\p{L}\p{N}_"
BLANK = r" \t\n\x0B\f\r\x{00A0}"


def spark_pattern(spec: str) -> str:
    body = spec.replace("_", f"[{BLANK}]+").replace("<", f"(?<![{WORDCHAR}])").replace(">", f"(?![{WORDCHAR}])")
    return f"(?u){body[1:]}" if spec.startswith("=") else f"(?iu){body}"


def sql_pattern(spec: str) -> str:
    return ("" if spec.startswith("=") else "(?i)") + spec.removeprefix("=").replace("_", "\x1f@\x1e").replace("<", "\x1e").replace(">", "\x1f").replace("@", f"[{BLANK}]+").replace("'", "''")


def sql_marked(text: str) -> str:
    """SQL for a text with its words marked."""
    return f"regexp_replace({text}, '([{WORDCHAR}]+)', chr(30) || '\\1' || chr(31), 'g')"


def sql_bare(text: str) -> str:
    return f"replace(replace({text}, chr(30), ''), chr(31), '')"


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern: array of (start, end, value), in code points from 0, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value"))), lambda p: p["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + p["gap"]
        end = begin + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"))).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def count(text: Column, spec: str) -> Column:
    return F.regexp_count(text, F.lit(spark_pattern(spec)))


def sql_count(text: str, spec: str) -> str:
    return f"len(regexp_extract_all({sql_marked(text)}, '{sql_pattern(spec)}'))"
