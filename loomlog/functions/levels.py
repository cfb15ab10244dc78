"""Level lookups (P11, P12), as SQL text over column names and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.fixed import grammar
from loomlog.fixed.levels import ALIASES, DECORATIONS, DEFAULT_LEVEL, LEVELS
from loomlog.functions.text import group_sql, quoted


# A test of the first letter is much cheaper than a word-boundary test at every position.
_LEVEL_ANYWHERE = "(?=[TDINWECFPA])" + grammar.LEVEL_ANYWHERE


def _map_sql(pairs: dict) -> str:
    return f"map({', '.join(f'{k!r}, {v!r}' for k, v in pairs.items())})"


def alias_level_sql(word: str) -> str:
    """Numeric level of an upper-case word, null if it is none."""
    return f"try_element_at({_map_sql({a: LEVELS[n] for a, n in ALIASES.items()})}, {word})"


def lookup_level_sql(token: str) -> str:
    """Numeric level of a token in any case, with decorations such as ``[ERROR]:``."""
    return alias_level_sql(f"btrim(upper({token}), {quoted(DECORATIONS)})")


def parse_level_sql(token: str, default: int = DEFAULT_LEVEL) -> str:
    return f"coalesce({lookup_level_sql(token)}, {default})"


def level_from_text_sql(text: str) -> str:
    """The first upper-case level word anywhere in the text, else INFO."""
    return f"coalesce({alias_level_sql(group_sql(text, _LEVEL_ANYWHERE, 1))}, {DEFAULT_LEVEL})"


def level_name_sql(level: str) -> str:
    return f"try_element_at({_map_sql({v: n for n, v in LEVELS.items()})}, {level})"


def lookup_level(token: str) -> Column:
    return F.expr(lookup_level_sql(token))


def parse_level_token(token: str) -> Column:
    return F.expr(parse_level_sql(token))


def level_name(level: str) -> Column:
    return F.expr(level_name_sql(level))
