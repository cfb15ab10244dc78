import re

import pytest

from loomlog.operators.filters import (
    FilterSpec, add_search_spans, apply_filters, build_spec, parse_filtered,
)


def brute_spans(text, terms):
    low, spans = text.lower(), []
    for term in [t for t in terms if t]:
        at = low.find(term)
        while at != -1:
            end = at + len(term)
            if all(e <= at or end <= s for s, e in spans):
                spans.append((at, end))
            at = low.find(term, end)
    return sorted(spans)


@pytest.mark.parametrize("text,terms", [
    ("redis timeout in redis", ("redis",)), ("abcdef", ("abc", "bcd")), ("anything", ()),
    ("Redis timeout", ("redis",)), ("text", ("",)), ("aaaaa", ("aa", "a")), ("", ("x",)),
    ("a.b\\E.c (x) a.b", ("a.b", "\\e", "(x)")),
    ("é deadlock é lock wait LOCK", ("lock", "deadlock", "é")),
])
def test_search_spans(spark, text, terms):
    df = spark.createDataFrame([(text,)], "raw string")
    (row,) = add_search_spans(df, "raw", terms).collect()
    assert [(s.start, s.end) for s in row.spans] == brute_spans(text, terms)


def test_spec_from_user_input():
    spec = build_spec(
        min_level="warning", include=" Redis, ,DB ", exclude="healthz", exclude_regex="^a, b$",
        search="Timeout, DEADLOCK",
    )
    assert spec.min_level == 30 and spec.include == ("redis", "db")
    assert spec.exclude_regex == ("^a", "b$") and spec.search == ("timeout", "deadlock")
    assert build_spec(min_level="crit").min_level is None
    assert build_spec(search="x").is_empty() and FilterSpec().is_empty()
    with pytest.raises(ValueError, match="exclude pattern"):
        build_spec(exclude_regex="(")


def test_description():
    spec = build_spec(min_level="ERROR", include="redis", exclude="healthz", search="x")
    assert spec.describe() == (
        "level >= ERROR; contains all of [redis]; excludes [healthz]; highlighting [x]"
    )
    assert build_spec(search="redis").describe() == "highlighting [redis]"
    assert FilterSpec().describe() == "no filters (showing everything)"
    assert build_spec(sources=["b", "a"], error_only=True, exclude_regex="x").describe() == (
        "errors only; source in {a, b}; 1 regex exclude(s)"
    )


def test_empty_filter_returns_its_input(spark):
    df = spark.range(3)
    assert apply_filters(df, build_spec(search="x")) is df


@pytest.mark.parametrize("pattern", [
    r"(?P<my_id>x)y(?P=my_id)", r"[[a]b", r"x{,3}z", r"[a&&b]c", r"[]a]q", r"end\Z", r"{x}", r"a{2}",
    r"[^]]w", r"\[b",
])
def test_patterns_mean_what_they_mean_in_python(spark, pattern):
    texts = ["xyx", "xyz", "[b", "ab", "&c", "bc", "z", "xxz", "]q", "the end", "end.", "{x}", "aa",
             "a{2}", "]w", "qw", "nothing", "\\Z"]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    kept = [r.raw for r in apply_filters(df, build_spec(exclude_regex=[pattern])).collect()]
    assert kept == [t for t in texts if not re.search(pattern, t, re.IGNORECASE)]


@pytest.mark.parametrize("pattern", [r"(x)(?(1)y|z)", "(", r"[z-a]"])
def test_patterns_that_cannot_run_are_refused(spark, pattern):
    with pytest.raises(ValueError, match="exclude pattern"):
        build_spec(exclude_regex=[pattern])


def test_raw_conditions_run_before_the_parse(spark):
    lines = spark.createDataFrame(
        [("ERROR redis down", "a.log", 1), ("ERROR disk", "a.log", 2), ("INFO redis up", "a.log", 3)],
        "raw string, source string, line_number bigint",
    )
    spec = build_spec(min_level="ERROR", include="redis")
    found = parse_filtered(lines, spec, columns=["raw", "level", "source"])
    assert [r.raw for r in found.collect()] == ["ERROR redis down"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Contains(lower(raw" in line or "Generate" in line]
    assert "Generate" in steps[0] and "Contains" in steps[-1]
