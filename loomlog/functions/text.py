"""Column helpers on text, and the display functions C1-C7."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Python's ``str.strip`` removes; Spark's ``trim`` alone only drops spaces.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def lstrip(col: Column, chars: str = WHITESPACE) -> Column:
    return F.ltrim(col, F.lit(chars))


def regex(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Java form of a pattern: ``.`` and ``$`` know only ``\\n`` as line end."""
    flags = "d" + ("i" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags}){pattern}"


def group(col: Column, pattern: str, index: int, ignore_case: bool = False) -> Column:
    """One group of the leftmost match; '' without a match."""
    return F.regexp_extract(col, regex(pattern, ignore_case), index)


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(regex(pattern, ignore_case))


def empty_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any_sql(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def contains_all_sql(column: str, words: Iterable[str]) -> str:
    return "(" + " AND ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def pattern_sql(pattern: str, ignore_case: bool = False) -> str:
    return quoted(regex(pattern, ignore_case))


def matches_sql(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"{column} RLIKE {pattern_sql(pattern, ignore_case)}"


def group_sql(column: str, pattern: str, index: int, ignore_case: bool = False) -> str:
    return f"regexp_extract({column}, {pattern_sql(pattern, ignore_case)}, {index})"


def pieces_sql(
    column: str, pattern: str, groups: Iterable[int], ignore_case: bool = False
) -> str:
    """All wanted groups of a whole-line pattern from one run of it.

    The line is replaced by its groups, one per line, and split; a line that does not match
    stays one piece. For text without line breaks.
    """
    joined = quoted("\n".join(f"${n}" for n in groups))
    return f"split(regexp_replace({column}, {pattern_sql(pattern, ignore_case)}, {joined}), '\\n')"


def strip_sql(column: str) -> str:
    return f"btrim({column}, {quoted(WHITESPACE)})"


def lstrip_sql(column: str, chars: str = WHITESPACE) -> str:
    return f"trim(LEADING {quoted(chars)} FROM {column})"


def pad_right(col: Column, width: int) -> Column:
    """Pad with spaces to ``width``; a longer text stays whole (``rpad`` would cut it)."""
    return F.when(F.length(col) < width, F.rpad(col, width, " ")).otherwise(col)


# -- display functions -------------------------------------------------------------------

# Size units.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")

# Epochs that a calendar date up to the year 9999 can show.
_MAX_EPOCH = 253_402_300_800


def format_timestamp(epoch: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text in the session time zone, ``-`` if missing or out of range."""
    shown = (epoch > 0) & (epoch < _MAX_EPOCH)
    micros = F.when(shown, F.floor(epoch * 1_000_000).cast("bigint"))
    return F.coalesce(F.date_format(F.timestamp_micros(micros), fmt), F.lit("-"))


def truncate_string(col: Column, max_length: int = 50, suffix: str = "...") -> Column:
    """Cut to ``max_length`` characters, the suffix included."""
    if max_length <= len(suffix):
        cut = F.substring(col, 1, max_length)
    else:
        cut = F.concat(F.substring(col, 1, max_length - len(suffix)), F.lit(suffix))
    return (
        F.when(col.isNull(), F.lit(""))
        .when(F.length(col) <= max_length, col)
        .otherwise(cut)
    )


def _replace_each(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def escape_html(col: Column) -> Column:
    """C3."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return _replace_each(F.coalesce(col.cast("string"), F.lit("")), pairs)


def _two_decimals(x: Column) -> Column:
    """A number >= 0 with two decimals, rounded by its exact binary value, ties to even.

    Java's ``%.2f`` rounds the shortest decimal form upwards instead. ``x`` is split in two
    halves so that its distance from the middle of two cents is computed without error.
    """
    scaled = x * 134_217_729.0
    high = scaled - (scaled - x)
    cents = F.floor(x * 100).cast("bigint")
    above = (high * 1000 - (cents * 10 + 5)) + (x - high) * 1000
    up = (above > 0) | ((above == 0) & (cents % 2 == 1))
    whole = cents + up.cast("bigint")
    return F.concat(
        F.floor(whole / 100).cast("bigint"), F.lit("."),
        F.lpad((whole % 100).cast("string"), 2, "0"),
    )


def human_readable_size(size: Column) -> Column:
    """C4: binary units; beyond the largest unit the number keeps growing."""
    size = size.cast("double")
    out = F.when(size <= 0, F.lit("0 B"))
    for power, unit in enumerate(SIZE_UNITS):
        if unit == "B":
            text = F.concat(F.floor(size).cast("string"), F.lit(" B"))
        else:
            text = F.concat(_two_decimals(size / (1024.0 ** power)), F.lit(" " + unit))
        if power == len(SIZE_UNITS) - 1:
            return out.otherwise(text)
        out = out.when(size < 1024.0 ** (power + 1), text)
    return out


def format_duration(seconds: Column) -> Column:
    """``45ms``, ``1.50s``, ``1m 30s``, ``1h 1m``, ``1d 1h``; ``-`` if missing."""
    seconds = seconds.cast("double")
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    hours = F.floor(whole / 3600).cast("bigint")
    days = F.floor(whole / 86_400).cast("bigint")
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("-"))
        .when(seconds < 1, F.concat(F.bround(seconds * 1000, 0).cast("bigint"), F.lit("ms")))
        .when(seconds < 60, F.concat(_two_decimals(seconds), F.lit("s")))
        .when(whole < 3600, F.concat(minutes, F.lit("m "), whole % 60, F.lit("s")))
        .when(whole < 86_400, F.concat(hours, F.lit("h "), minutes % 60, F.lit("m")))
        .otherwise(F.concat(days, F.lit("d "), hours % 24, F.lit("h")))
    )


def base_name(path: Column) -> Column:
    """C6."""
    return F.substring_index(path, "/", -1)


def markdown_cell(col: Column) -> Column:
    """C7."""
    pairs = (("\\", "\\\\"), ("|", "\\|"), ("\r", " "), ("\n", " "))
    return _replace_each(F.coalesce(col.cast("string"), F.lit("N/A")), pairs)


def with_thousands(col: Column) -> Column:
    return F.format_number(col, 0)
