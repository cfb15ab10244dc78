"""Signature classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from loomlog.fixed import grammar
from loomlog.fixed.levels import DEFAULT_LEVEL
from loomlog.fixed.signatures import GATE_NUMBERS, GATE_WORDS, SIGNATURES, Signature
from loomlog.functions.levels import level_from_text_sql
from loomlog.functions.text import contains_any_sql, group_sql, matches_sql, quoted


# Letters a match of a frequently tried pattern can begin with. Testing them first spares
# the word-boundary test at most positions of the text.
_FIRST_LETTERS = {"http_5xx": "shrc5", "http_4xx": "shrc4", "slow_query": "sqted"}
# What a match of the exception pattern must contain, in this case.
_EXCEPTION_WORDS = ("Error", "Exception", "Traceback")


def by_severity(signatures: Sequence[Signature]) -> list[Signature]:
    """Evaluation order: falling severity, declaration order among equals."""
    return sorted(signatures, key=lambda s: -s.severity)


def error_gate_sql(text: str, lowered: str) -> str:
    """Only texts passing this are classified.

    Substring tests on the lower-cased text cost a tenth of one case-blind alternation.
    """
    return f"({contains_any_sql(lowered, GATE_WORDS)} OR {matches_sql(text, GATE_NUMBERS)})"


def signature_sql(
    text: str, lowered: str, signatures: Sequence[Signature] = SIGNATURES
) -> str:
    """The first signature whose hint and pattern both match; null if none does.

    One CASE in severity order, so a row pays only for the substring tests up to its match
    and for the few patterns whose hint is present.
    """
    tests = []
    for sig in by_severity(signatures):
        test = _pattern_test(sig, text)
        if sig.hints is not None:
            test = f"{contains_any_sql(lowered, sig.hints)} AND {test}"
        tests.append(f"WHEN {test} THEN {quoted(sig.name)}")
    return f"CASE {' '.join(tests)} END" if tests else "CAST(NULL AS STRING)"


def _pattern_test(sig: Signature, text: str) -> str:
    built_in = sig in SIGNATURES
    if built_in and sig.name in _FIRST_LETTERS:
        pattern = f"(?=[{_FIRST_LETTERS[sig.name]}])(?:{sig.pattern})"
        return matches_sql(text, pattern, sig.ignore_case)
    test = matches_sql(text, sig.pattern, sig.ignore_case)
    if built_in and sig.name == "python_traceback":
        return f"{contains_any_sql(text, _EXCEPTION_WORDS)} AND {test}"
    return test


def severity_floor_sql(name: str, signatures: Sequence[Signature] = SIGNATURES) -> str:
    """The lowest level a signature allows; null without a signature."""
    floors = [
        f"{quoted(s.name)}, {max(s.severity // 10 * 10, DEFAULT_LEVEL)}" for s in signatures
    ]
    return f"try_element_at(map({', '.join(floors)}), {name})" if floors else "CAST(NULL AS INT)"


def duration_sql(text: str) -> str:
    """The first run of three or more digits followed by ``ms``."""
    digits = group_sql(text, grammar.DURATION_MS, 1, ignore_case=True)
    return (
        f"CASE WHEN contains({text}, 'ms') OR contains({text}, 'MS') "
        f"THEN try_cast({digits} AS BIGINT) END"
    )


def classify(
    df: DataFrame, text: str, signatures: Sequence[Signature] = SIGNATURES
) -> DataFrame:
    """Add ``min_level``, ``signature`` and ``duration_ms`` for the texts of one column.

    ``min_level`` is the evidence in the text alone; callers combine it with a stated level.
    """
    kept = df.columns
    staged = df.selectExpr("*", f"lower({text}) AS _lowered")
    staged = staged.selectExpr("*", f"{error_gate_sql(text, '_lowered')} AS _gate")
    staged = staged.selectExpr(
        "*",
        f"CASE WHEN _gate THEN {signature_sql(text, '_lowered', signatures)} END AS signature",
    )
    floor = severity_floor_sql("signature", signatures)
    return staged.selectExpr(
        *kept,
        f"greatest({level_from_text_sql(text)}, {floor}) AS min_level",
        "coalesce(signature, '') AS signature",
        f"{duration_sql(text)} AS duration_ms",
    )


def signature_table(
    spark: SparkSession, signatures: Sequence[Signature] = SIGNATURES
) -> DataFrame:
    """The signatures as a small table, in evaluation order."""
    rows = [
        (s.name, i, s.category, s.severity, s.pattern, list(s.hints or ()))
        for i, s in enumerate(by_severity(signatures))
    ]
    return spark.createDataFrame(
        rows,
        "name string, sig_order int, category string, severity int, "
        "pattern string, hints array<string>",
    )
