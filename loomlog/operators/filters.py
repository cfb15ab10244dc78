"""Filters on entries (F1-F10) and search spans."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.fixed.filters import NO_FILTER, WORDINGS
from loomlog.fixed.levels import ALIASES, ERROR, FILTER_WORDS, LEVELS
from loomlog.functions.text import regex
from loomlog.operators.parse import parse_logs

_LEVEL_NAMES = {value: name for name, value in LEVELS.items()}


@dataclass(frozen=True)
class Condition:
    """One kind of condition: the column it reads, its tests, and its value in words."""

    reads: str
    tests: Callable[[object, Column], list[Column]]
    words: Callable[[object], str] = ", ".join


def _each(test: Callable[[Column, str], Column]):
    return lambda values, column: [test(column, value) for value in values]


def _holds(column: Column, word: str) -> Column:
    return F.contains(F.lower(column), F.lit(word))


CONDITIONS = {
    "min_level": Condition("level", lambda v, c: [c >= v], _LEVEL_NAMES.get),
    "max_level": Condition("level", lambda v, c: [c <= v], _LEVEL_NAMES.get),
    "error_only": Condition("level", lambda v, c: [c >= ERROR], str),
    "sources": Condition(
        "source", lambda v, c: [c.isin(sorted(v))], lambda v: ", ".join(sorted(v))
    ),
    "include": Condition("raw", _each(_holds)),
    "exclude": Condition("raw", _each(lambda c, word: ~_holds(c, word))),
    "exclude_regex": Condition(
        "raw", _each(lambda c, p: ~c.rlike(regex(java_pattern(p), ignore_case=True))), len
    ),
    "search": Condition("", lambda v, c: []),  # marks, never hides
}


class FilterSpec:
    """What to keep. Every condition that is given must hold."""

    def __init__(self, **given) -> None:
        unknown = given.keys() - CONDITIONS.keys()
        if unknown:
            raise TypeError(f"no such condition: {', '.join(sorted(unknown))}")
        self.given = {name: given[name] for name in CONDITIONS if given.get(name)}

    def __getattr__(self, name: str):
        if name in CONDITIONS:
            return self.given.get(name)
        raise AttributeError(name)

    def is_empty(self) -> bool:
        return not self.given.keys() - {"search"}

    def describe(self) -> str:
        """the filter in words, as stored with an export."""
        said = [WORDINGS[k].format(CONDITIONS[k].words(v)) for k, v in self.given.items()]
        return "; ".join(said) or NO_FILTER

    def condition(self, reads: tuple[str, ...] = ("level", "source", "raw")) -> Column | None:
        """One boolean column over the columns named; None if nothing is asked of them."""
        tests = [
            test
            for name, value in self.given.items()
            if CONDITIONS[name].reads in reads
            for test in CONDITIONS[name].tests(value, F.col(CONDITIONS[name].reads))
        ]
        return reduce(and_, tests) if tests else None


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """F8: works on batch and streaming frames; an empty filter returns ``df`` itself."""
    return _kept(df, spec.condition())


def _kept(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.filter(condition)


def parse_filtered(lines: DataFrame, spec: FilterSpec, **options) -> DataFrame:
    """Entries that pass a filter. What is asked of the raw text is asked before the parse, so
    lines that fail it cost no more than their scan."""
    entries = parse_logs(_kept(lines, spec.condition(("raw",))), **options)
    return _kept(entries, spec.condition(("level", "source")))


_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")


def java_pattern(pattern: str) -> str:
    """A pattern in Python's dialect written in Java's. What Java has no form for is refused.

    Group names become plain ones, ``[`` and ``&&`` in a class are literal, ``{,n}`` starts at
    zero, and a brace that is no quantifier stands for itself.
    """
    out, names, at, in_class = [], {}, 0, False
    while at < len(pattern):
        rest, taken = pattern[at:], 1
        if rest[0] == "\\":
            taken = 2
            out.append("\\z" if rest[:2] == "\\Z" and not in_class else rest[:2])
        elif in_class:
            in_class = rest[0] != "]"
            out.append("\\" + rest[0] if rest[0] in "[&" else rest[0])
        elif opened := re.match(r"\[\^?\]?", rest):
            in_class, taken = True, opened.end()
            out.append(opened[0].replace("]", "\\]"))
        elif group := re.match(r"\(\?P<(\w+)>", rest):
            taken = group.end()
            out.append(f"(?<{names.setdefault(group[1], f'g{len(names)}')}>")
        elif back := re.match(r"\(\?P=(\w+)\)", rest):
            taken = back.end()
            out.append(f"\\k<{names.get(back[1], back[1])}>")
        elif rest.startswith("(?("):
            raise ValueError(f"exclude pattern {pattern!r} is refused: conditional groups")
        elif rest[0] == "{":
            times = _QUANTIFIER.match(rest)
            if times and (times[1] or times[2]):
                taken = times.end()
                out.append(f"{{{times[1] or 0}{times[2]}{times[3]}}}")
            else:
                out.append("\\{")
        else:
            out.append(rest[0])
        at += taken
    return "".join(out)


def _checked(pattern: str) -> str:
    """Refuse a pattern that either dialect cannot read, before a job starts."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error as broken:
        raise ValueError(f"exclude pattern {pattern!r} is refused: {broken}") from broken
    spark = SparkSession.getActiveSession()
    if spark is not None:
        compiled = regex(java_pattern(pattern), ignore_case=True)
        try:
            spark._jvm.java.util.regex.Pattern.compile(compiled)
        except Exception as broken:
            raise ValueError(f"exclude pattern {pattern!r} is refused: {broken}") from broken
    return pattern


def _words(text: str | None) -> tuple[str, ...]:
    return tuple(filter(None, (word.strip().lower() for word in (text or "").split(","))))


def _level(given: str | int | None) -> int | None:
    word = given.strip().upper() if isinstance(given, str) else None
    if word is None:
        return given
    return LEVELS[ALIASES[word]] if word in FILTER_WORDS else None


def build_spec(
    *, min_level=None, max_level=None, sources=(), include=None, exclude=None,
    exclude_regex=(), error_only=False, search="",
) -> FilterSpec:
    """a filter from user input: words separated by commas, level names or numbers.

    Unknown level words are ignored; a broken regular expression is refused.
    """
    if isinstance(exclude_regex, str):
        exclude_regex = map(str.strip, exclude_regex.split(","))
    return FilterSpec(
        min_level=_level(min_level), max_level=_level(max_level), sources=frozenset(sources or ()),
        include=_words(include), exclude=_words(exclude),
        exclude_regex=tuple(_checked(p) for p in exclude_regex or () if p),
        error_only=error_only, search=_words(search),
    )


def add_search_spans(
    df: DataFrame, text: str, terms: tuple[str, ...], name: str = "spans"
) -> DataFrame:
    """where the lower-case terms occur, as sorted ``(start, end)`` without overlaps.

    Earlier terms have precedence. Splitting at a term gives its occurrences in one pass over
    the text, however long it is; positions are the running lengths of the parts.
    """
    kept = [F.col(c) for c in df.columns]
    df = df.withColumns({
        "_lowered": F.lower(F.col(text)),
        "_spans": F.expr("CAST(array() AS array<struct<start:int,end:int>>)"),
    })
    for term in [t for t in terms if t]:
        size = len(term)
        starts = f"""aggregate(
            slice(_parts, 1, size(_parts) - 1),
            struct(0 AS at, CAST(array() AS array<int>) AS found),
            (a, part) -> struct(a.at + length(part) + {size} AS at,
                                array_append(a.found, a.at + length(part)) AS found)
        ).found"""
        df = df.withColumn("_parts", F.split("_lowered", regex_quote(term), -1))
        df = df.withColumn("_starts", F.expr(starts))
        df = df.withColumn("_spans", F.expr(f"""concat(_spans, transform(
            filter(_starts, s -> NOT exists(
                _spans, p -> p.start < s + {size} AND s < p.end)),
            s -> struct(s AS start, s + {size} AS end)))"""))
    return df.select(*kept, F.array_sort("_spans").alias(name))


def regex_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


