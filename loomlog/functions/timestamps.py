"""Timestamp text -> epoch seconds.

Every accepted spelling is rewritten to the one ISO form that Spark's string cast reads,
so a row costs one cast whatever its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.fixed.grammar import MONTHS
from loomlog.functions.text import group_sql, matches_sql, pattern_sql, quoted, regex

# The accepted spellings.
_ZONE = r"(?:Z|z|[+-]\d{2}:?\d{2}(?::?\d{2})?|[+-]\d{2})"
_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?{_ZONE}?)?$"
_ISO_BASIC = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[T ](\d{{2}}):?(\d{{2}}):?(\d{{2}})({_ZONE}?))?$"
_SYSLOG = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+([\d:]{8})"
_AFTER_MONTH = r"^\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2}).*$"
_SHORT_ISO = (
    r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    r"(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,6}))?)?)?$"
)
_SLASHED = r"^(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
_CLF = (
    r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{1,2}:\d{1,2}:\d{1,2})\s+"
    r"(Z|[+-]\d{2}:?\d{2})$"
)
_DAY_SECONDS = 86_400


def _month_sql(name: str) -> str:
    """Two-digit month of an abbreviation, null if it is none."""
    at = f"instr({quoted(' '.join(MONTHS))}, lower({name}))"
    number = f"lpad(CAST(CAST(({at} + 3) / 4 AS INT) AS STRING), 2, '0')"
    return f"CASE WHEN length({name}) = 3 AND {at} % 4 = 1 THEN {number} END"


def _rewrite_sql(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {pattern_sql(pattern)}, {quoted(replacement)})"


def _is_syslog_sql(stamp: str) -> str:
    return f"(substring({stamp}, 1, 1) BETWEEN 'A' AND 'Z' AND {matches_sql(stamp, _SYSLOG)})"


def _calendar_sql(stamp: str) -> str:
    """The stamp as ``yyyy-MM-dd HH:mm:ss`` text; a syslog stamp gets the year of ``_as_of``."""
    after_month = quoted(regex(_AFTER_MONTH, dot_all=True))
    syslog = (
        f"concat(year(_as_of), '-', {_month_sql(f'substring({stamp}, 1, 3)')}, "
        f"regexp_replace(substring({stamp}, 4), {after_month}, '-$1 $2'))"
    )
    clf = (
        f"concat({group_sql(stamp, _CLF, 3)}, '-', {_month_sql(group_sql(stamp, _CLF, 2))}, "
        f"{_rewrite_sql(stamp, _CLF, '-$1 $4$5')})"
    )
    basic = (
        f"CASE WHEN length({stamp}) = 8 THEN {_rewrite_sql(stamp, _ISO_BASIC, '$1-$2-$3')} "
        f"ELSE {_rewrite_sql(stamp, _ISO_BASIC, '$1-$2-$3 $4:$5:$6$7')} END"
    )
    return f"""CASE WHEN {stamp} = '' THEN NULL
      WHEN {matches_sql(stamp, _ISO)} THEN replace(upper({stamp}), ',', '.')
      WHEN {_is_syslog_sql(stamp)} THEN {syslog}
      WHEN NOT substring({stamp}, 1, 1) BETWEEN '0' AND '9' THEN NULL
      WHEN {matches_sql(stamp, _CLF)} THEN {clf}
      WHEN {matches_sql(stamp, _SHORT_ISO)} THEN replace({stamp}, ',', '.')
      WHEN {matches_sql(stamp, _SLASHED)} THEN {_rewrite_sql(stamp, _SLASHED, '$1-$2-$3 $4:$5:$6')}
      WHEN {matches_sql(stamp, _US)} THEN {_rewrite_sql(stamp, _US, '$3-$1-$2 $4:$5:$6')}
      WHEN {matches_sql(stamp, _ISO_BASIC)} THEN {basic} END"""


def with_epoch(
    df: DataFrame, stamp: str, name: str = "ts_epoch", as_of: Column | None = None
) -> DataFrame:
    """Add the epoch seconds of a timestamp text, 0.0 if unknown.

    ``as_of`` is the moment that decides the year of a syslog stamp, which carries none; a
    date more than a day ahead of it belongs to the year before. Stamps without a zone are
    read in the session time zone.
    """
    kept = [c for c in df.columns if c != name]
    df = df.withColumn("_as_of", F.current_timestamp() if as_of is None else as_of)
    df = df.selectExpr("*", f"{_calendar_sql(stamp)} AS _calendar")
    df = df.selectExpr("*", "unix_micros(try_cast(_calendar AS TIMESTAMP)) AS _micros")
    limit = f"unix_micros(_as_of) + {_DAY_SECONDS * 1_000_000}"
    back = (
        "unix_micros(try_cast(concat(year(_as_of) - 1, substring(_calendar, 5)) AS TIMESTAMP))"
    )
    micros = (
        f"CASE WHEN _micros > {limit} AND {_is_syslog_sql(stamp)} THEN {back} ELSE _micros END"
    )
    return df.selectExpr(*kept, f"coalesce({micros} / 1000000, 0.0D) AS {name}")
