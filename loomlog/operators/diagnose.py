"""Rule-based diagnosis of entries."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from loomlog.fixed import diagnosis as fixed
from loomlog.fixed.rules import RULES, Rule
from loomlog.functions.text import (
    contains_any_sql,
    empty_to_null,
    lstrip,
    quoted,
    regex,
    strip,
)

_STEP = "struct<title:string,description:string,command:string,severity:string>"
RULE_SCHEMA = (
    "rule_id string, rule_order int, title string, category string, root_cause string, "
    "confidence string, priority int, patterns array<string>, hints array<string>, "
    "checks array<struct<title:string,description:string,command:string>>, "
    "prevention array<string>, docs array<string>"
)


def rules_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rules as a small table, in tie-break order: a literal in the plan, so that using
    it costs no job over Python rows."""
    step = ("title", "description", "command")
    rows = [
        {
            **rule._asdict(), "rule_order": i, "hints": rule.hints or (),
            "checks": [dict(zip(step, check)) for check in rule.checks],
        }
        for i, rule in enumerate(rules)
    ]
    kind = ArrayType(StructType.fromDDL(RULE_SCHEMA))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _rule_hit(index: int, rule: Rule, text: str, lowered: str) -> str:
    """SQL: the longest of the rule's matches (the earlier pattern among equals)."""
    found = ", ".join(
        f"regexp_extract({text}, {quoted(regex(p, ignore_case=True))}, 0)" for p in rule.patterns
    )
    best = (
        f"array_max(transform(array({found}), "
        "(m, i) -> struct(length(m) AS len, -i AS place, m AS matched)))"
    )
    if rule.hints is not None:
        best = f"CASE WHEN {contains_any_sql(lowered, rule.hints)} THEN {best} END"
    return (
        f"struct({rule.priority * fixed.PRIORITY_WEIGHT} AS bonus, {-index} AS place, "
        f"{quoted(rule.rule_id)} AS rule_id, {best} AS best)"
    )


def match_rules(
    df: DataFrame,
    text: str = "raw",
    rules: Sequence[Rule] = RULES,
    limit: int = fixed.RULES_KEPT,
    name: str = "hits",
) -> DataFrame:
    """Add the best matching rules of a text as ``array<struct<rule_id, matched>>``.

    Score is the length of the match plus a hundred per priority; then length, then rule
    order. A narrow expression on each row: rows with equal texts are not worth a shuffle,
    since raw lines carry timestamps.
    """
    kept = [F.col(c) for c in df.columns if c != name]
    hits = ", ".join(_rule_hit(i, r, text, "_lowered") for i, r in enumerate(rules))
    ranked = f"""sort_array(transform(
        filter(array({hits}), h -> h.best.len > 0),
        h -> struct(h.best.len + h.bonus AS score, h.best.len AS len, h.place AS place,
                    h.rule_id AS rule_id, h.best.matched AS matched)), false)"""
    top = f"""transform(slice({ranked}, 1, {limit}),
        h -> struct(h.rule_id AS rule_id, h.matched AS matched))"""
    lowered = df.withColumn("_lowered", F.lower(F.col(text)))
    return lowered.select(*kept, F.expr(top).alias(name))


def best_rule(df: DataFrame, text: str = "raw", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``rule_id`` and ``matched`` of the best rule, null without one."""
    found = match_rules(df, text, rules, limit=1)
    hit = F.get("hits", 0)
    return found.withColumns({
        "rule_id": hit["rule_id"], "matched": hit["matched"],
    }).drop("hits")


def with_rule_details(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Attach the rule of ``rule_id``. The rule table is a list the driver holds anyway,
    so it is sent to every task."""
    return df.join(F.broadcast(rules_table(df.sparkSession, rules)), "rule_id", "left")


def with_category(df: DataFrame, text: str = "raw", rules: Sequence[Rule] = RULES) -> DataFrame:
    """D3."""
    categories = rules_table(df.sparkSession, rules).select("rule_id", "category")
    joined = best_rule(df, text, rules).join(F.broadcast(categories), "rule_id", "left")
    return joined.select(
        *df.columns,
        F.coalesce("category", F.lit(fixed.GENERAL_CATEGORY)).alias("category"),
    )


def category_counts(df: DataFrame, text: str = "raw", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rows per diagnosis category."""
    return with_category(df, text, rules).groupBy("category").agg(F.count("*").alias("cnt"))


def infer_severity(lowered: str) -> Column:
    """The first tier one of whose words is in the text."""
    tiers = " ".join(
        f"WHEN {contains_any_sql(lowered, words)} THEN {quoted(name)}"
        for name, words in fixed.SEVERITY_WORDS
    )
    return F.expr(f"CASE {tiers} ELSE {quoted(fixed.DEFAULT_SEVERITY)} END")


def generic_title(text: Column) -> Column:
    """The first six words."""
    words = F.slice(F.split(strip(text), " ", fixed.TITLE_WORDS + 1), 1, fixed.TITLE_WORDS)
    title = F.substring(F.array_join(words, " "), 1, fixed.TITLE_CHARS)
    return F.coalesce(empty_to_null(title), F.lit(fixed.UNTITLED))


def salient(
    context: str, lines: int = fixed.SALIENT_LINES, chars: int = fixed.SALIENT_CHARS
) -> Column:
    """The last few context lines that speak of errors, shortened."""
    pattern = quoted(regex(fixed.SALIENT_PATTERN, ignore_case=True))
    return F.expr(f"""transform(
        reverse(slice(reverse(filter({context}, c -> c RLIKE {pattern})),
                      1, {lines})),
        c -> substring(c, 1, {chars}))""")


def worst_severity(steps: str) -> Column:
    """The highest severity of the steps, the first one among equals; low if none."""
    ranks = ", ".join(f"{quoted(n)}, {r}" for n, r in fixed.SEVERITY_RANK.items())
    return F.expr(f"""coalesce(array_max(transform({steps}, (s, i) -> struct(
        coalesce(try_element_at(map({ranks}), s.severity), 0) AS rank, -i AS place,
        s.severity AS severity))).severity, {quoted(fixed.DEFAULT_SEVERITY)})""")


def _text_array(items: Sequence[str]) -> str:
    return f"array({', '.join(quoted(i) for i in items)})"


def _unmatched_steps() -> str:
    steps = ", ".join(
        f"struct({quoted(t)} AS title, {quoted(d)} AS description, {quoted(c)} AS command, "
        f"{quoted(s)} AS severity)"
        for t, d, c, s in fixed.UNMATCHED_STEPS
    )
    return f"array({steps})"


def _ruled(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """Hits plus the details of the best rule and the first check of the runner-up."""
    found = match_rules(df, text, rules).withColumns({
        "rule_id": F.get("hits", 0)["rule_id"], "_second": F.get("hits", 1)["rule_id"],
    })
    details = rules_table(df.sparkSession, rules)
    second = details.select(
        F.col("rule_id").alias("_second"), F.get("checks", 0).alias("_also")
    )
    return with_rule_details(found, rules).join(F.broadcast(second), "_second", "left")


def diagnose(
    df: DataFrame,
    text: str = "raw",
    context: str | None = None,
    rules: Sequence[Rule] = RULES,
    salient_lines: int = fixed.SALIENT_LINES,
    salient_chars: int = fixed.SALIENT_CHARS,
    evidence_kept: int = fixed.EVIDENCE_KEPT,
) -> DataFrame:
    """The diagnosis of each row's text.

    ``salient_lines`` of the context, ``salient_chars`` of each, are evidence; ``evidence_kept``
    is how many pieces of it a matched row has. ``context`` names a column with the surrounding lines. Adds ``rule_id, hits, category,
    summary, root_cause, confidence, provider, evidence, recommendations, prevention, docs,
    severity, related_entries``.
    """
    lines = F.col(context) if context else F.expr("CAST(array() AS array<string>)")
    ruled = _ruled(df, text, rules).withColumns({
        "_lines": lines, "_lowered": F.lower(F.col(text)),
    })
    ruled = ruled.withColumns({
        "_step_severity": infer_severity("_lowered"), "_salient": salient("_lines", salient_lines, salient_chars),
    })
    steps = F.expr(f"""CASE WHEN rule_id IS NULL THEN {_unmatched_steps()} ELSE concat(
        transform(checks, c -> struct(c.title AS title, c.description AS description,
            nullif(c.command, '') AS command, _step_severity AS severity)),
        CASE WHEN _also IS NULL THEN CAST(array() AS array<{_STEP}>) ELSE array(struct(
            concat('Also check: ', _also.title) AS title, _also.description AS description,
            nullif(_also.command, '') AS command, 'medium' AS severity)) END) END""")
    evidence = F.expr(f"""CASE WHEN rule_id IS NULL
        THEN concat(array(concat('Input: ', substring({text}, 1, {fixed.INPUT_CHARS}))), _salient)
        ELSE slice(concat(
            transform(hits, (h, i) -> concat(
                CASE WHEN i = 0 THEN 'Matched rule \\'' ELSE 'Secondary match \\'' END,
                h.rule_id, '\\' on: ', h.matched)),
            _salient), 1, {evidence_kept}) END""")
    matched = F.col("rule_id").isNotNull()
    done = ruled.withColumn("recommendations", steps)
    return done.select(
        *df.columns, "rule_id", "hits",
        F.coalesce("category", F.lit(fixed.GENERAL_CATEGORY)).alias("category"),
        F.when(matched, F.col("title")).otherwise(generic_title(F.col(text))).alias("summary"),
        F.coalesce("root_cause", F.lit(fixed.UNMATCHED_CAUSE)).alias("root_cause"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.lit("offline").alias("provider"),
        evidence.alias("evidence"),
        "recommendations",
        F.when(matched, F.col("prevention"))
        .otherwise(F.expr(_text_array(fixed.UNMATCHED_PREVENTION))).alias("prevention"),
        F.coalesce("docs", F.expr("CAST(array() AS array<string>)")).alias("docs"),
        worst_severity("recommendations").alias("severity"),
        F.slice("_lines", 1, fixed.CONTEXT_LINES).alias("related_entries"),
    )


def recommendation_table(diagnosed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per recommended step, numbered from 1."""
    rows = diagnosed.select(*keys, F.posexplode("recommendations").alias("_at", "step"))
    return rows.select(
        *keys, (F.col("_at") + 1).alias("step_no"), "step.title", "step.description",
        "step.command", "step.severity",
    )


def prevention_table(diagnosed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per prevention hint, numbered from 1."""
    rows = diagnosed.select(*keys, F.posexplode("prevention").alias("_at", "hint"))
    return rows.select(*keys, (F.col("_at") + 1).alias("hint_no"), "hint")


def diagnosis_text(elapsed_ms: int = 0, evidence_lines: int = 6) -> Column:
    """A diagnosis as a block of text, with so many lines of evidence."""

    def section(title: str, lines: str) -> str:
        return f"""CASE WHEN size({lines}) > 0
            THEN concat(array('', '{title}'), {lines}) ELSE CAST(array() AS array<string>) END"""

    bullets = "transform({0}, x -> concat('  - ', x))"
    steps = """flatten(transform(recommendations, (r, i) -> array_compact(array(
        concat('  ', i + 1, '. ', r.title, '  [', r.severity, ']'),
        CASE WHEN r.description <> '' THEN concat('     ', r.description) END,
        CASE WHEN r.command <> '' THEN concat('     $ ', r.command) END))))"""
    return F.expr(f"""array_join(concat(
        array(concat('[', upper(confidence), '] ', summary),
              concat('Source: ', provider, ' ({elapsed_ms} ms)'),
              concat('Root cause: ', root_cause)),
        {section('Evidence:', bullets.format(f'slice(evidence, 1, {evidence_lines})'))},
        {section('Next steps:', steps)},
        {section('Prevention:', bullets.format('prevention'))},
        {section('References:', bullets.format('docs'))}), '\\n')""")


def with_prompt(
    df: DataFrame,
    text: str = "raw",
    context: str | None = None,
    rules: Sequence[Rule] = RULES,
    prompt_chars: int = fixed.PROMPT_CHARS,
) -> DataFrame:
    """Add the ``prompt`` that asks for a second opinion on each row's text."""
    found = match_rules(df, text, rules, name="_hits")
    causes = ", ".join(f"{quoted(r.rule_id)}, {quoted(r.root_cause)}" for r in rules)
    lines = context or "CAST(array() AS array<string>)"
    prompt = F.expr(f"""array_join(concat(
        array(concat('TARGET LOG LINE:\\n', {text})),
        CASE WHEN size({lines}) > 0 THEN concat(array('SURROUNDING LOG LINES:'),
            transform({lines}, c -> concat('  ', c))) ELSE CAST(array() AS array<string>) END,
        CASE WHEN size(_hits) > 0 THEN concat(
            array('KNOWN SIGNATURES (verify, do not assume):'),
            transform(_hits, h -> concat('  - ', h.rule_id, ': matched \\'', h.matched,
                '\\' -> ', try_element_at(map({causes}), h.rule_id))))
            ELSE CAST(array() AS array<string>) END), '\\n')""")
    return found.select(
        *df.columns, F.substring(prompt, 1, prompt_chars).alias("prompt")
    )


def parse_reply(df: DataFrame, reply: str = "reply", name: str = "answer") -> DataFrame:
    """The JSON object in a reply as VARIANT, null if there is none.

    A code fence is taken off first; failing that, the text from the first ``{`` to the last
    ``}`` is tried.
    """
    fence = regex(r"^\s*```(?:json)?\s*|\s*```\s*$", ignore_case=True)
    df = df.withColumn("_bare", F.regexp_replace(strip(F.col(reply)), fence, ""))
    whole = F.try_parse_json(strip(F.col("_bare")))
    part = F.try_parse_json(F.regexp_extract("_bare", regex(r"\{.*\}", dot_all=True), 0))

    def is_object(v: Column) -> Column:
        return F.schema_of_variant(v).startswith("OBJECT")

    df = df.withColumns({"_whole": whole, "_part": part})
    # a reply that is valid JSON but no object is not searched any further
    answer = F.when(
        F.col("_whole").isNotNull(), F.when(is_object(F.col("_whole")), F.col("_whole"))
    ).otherwise(F.when(is_object(F.col("_part")), F.col("_part")))
    kept = [c for c in df.columns if not c.startswith("_") and c != name]
    return df.select(*kept, answer.alias(name))


def _reply_text(key: str) -> Column:
    return F.try_variant_get("answer", f"$.{key}", "string")


def _reply_list(key: str) -> str:
    """SQL: the non-empty items of a list in the reply, as text."""
    return f"""coalesce(filter(
        try_cast(try_variant_get(answer, '$.{key}', 'variant') AS array<string>),
        x -> x IS NOT NULL AND x <> ''), CAST(array() AS array<string>))"""


def merge_replies(
    df: DataFrame,
    replies: DataFrame,
    key: str,
    text: str = "raw",
    context: str | None = None,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """The replies of providers ``(key, provider, reply)`` merged with the rules.

    Of several replies for a key the first readable one counts, by a column ``rank`` if there
    is one, then by provider. Rule evidence is always added, and a reply without steps gets the
    rule's own. Rows without a readable reply keep their rule diagnosis.
    """
    offline = diagnose(df, text, context, rules)
    ranked = ["rank"] if "rank" in replies.columns else []
    place = F.struct(*ranked, "provider", F.to_json("answer").alias("text"))
    readable = parse_reply(replies).filter(F.col("answer").isNotNull())
    first = F.min_by(F.struct(F.col("provider").alias("_provider"), "answer"), place)
    answers = readable.groupBy(key).agg(first.alias("first")).select(key, "first.*")
    both = offline.join(answers, key, "left")
    checks = rules_table(df.sparkSession, rules).select("rule_id", "checks", "prevention", "docs")
    checks = checks.withColumnsRenamed({"prevention": "_prevention", "docs": "_docs"})
    both = both.join(F.broadcast(checks), "rule_id", "left")

    stated = F.lower(F.coalesce(_reply_text("confidence"), F.lit("")))
    confidence = F.when(
        lstrip(strip(stated)).isin(list(fixed.CONFIDENCES)), strip(stated)
    ).otherwise("medium")
    steps = f"""filter(transform(
        try_cast(try_variant_get(answer, '$.recommendations', 'variant') AS array<variant>),
        (r, i) -> CASE
            WHEN schema_of_variant(r) = 'STRING' THEN struct(
                concat('Step ', i + 1) AS title, CAST(r AS STRING) AS description,
                CAST(NULL AS STRING) AS command, 'medium' AS severity)
            WHEN startswith(schema_of_variant(r), 'OBJECT') THEN struct(
                coalesce(nullif(try_variant_get(r, '$.title', 'string'), ''),
                         concat('Step ', i + 1)) AS title,
                coalesce(try_variant_get(r, '$.description', 'string'), '') AS description,
                nullif(try_variant_get(r, '$.command', 'string'), '') AS command,
                lower(coalesce(nullif(try_variant_get(r, '$.severity', 'string'), ''),
                               'medium')) AS severity) END),
        s -> s IS NOT NULL)"""
    backstop = f"""coalesce(transform(slice(checks, 1, {fixed.REPLY_BACKSTOP_STEPS}),
        c -> struct(c.title AS title, c.description AS description,
            nullif(c.command, '') AS command, 'medium' AS severity)),
        CAST(array() AS array<{_STEP}>))"""
    both = both.withColumns({
        "_steps": F.expr(steps), "_listed": F.expr(_reply_list("prevention")),
    })
    merged_steps = F.expr(
        f"slice(CASE WHEN size(_steps) > 0 THEN _steps ELSE {backstop} END, "
        f"1, {fixed.REPLY_STEPS})"
    )
    evidence = F.expr(f"""slice(concat({_reply_list('evidence')}, transform(hits,
        h -> concat('Matched rule \\'', h.rule_id, '\\' on: ', h.matched))),
        1, {fixed.REPLY_EVIDENCE})""")
    prevention = F.expr(
        "slice(CASE WHEN size(_listed) > 0 THEN _listed "
        f"ELSE coalesce(_prevention, _listed) END, 1, {fixed.REPLY_PREVENTION})"
    )
    answered = F.col("answer").isNotNull()
    merged = {
        "summary": F.coalesce(
            empty_to_null(_reply_text("summary")), F.lit(fixed.REPLY_SUMMARY)
        ),
        "root_cause": F.coalesce(
            empty_to_null(_reply_text("root_cause")), F.lit(fixed.REPLY_CAUSE)
        ),
        "confidence": confidence,
        "provider": F.col("_provider"),
        "evidence": evidence,
        "recommendations": merged_steps,
        "prevention": prevention,
        "docs": F.coalesce("_docs", F.expr("CAST(array() AS array<string>)")),
    }
    done = both.withColumns({
        name: F.when(answered, value).otherwise(F.col(name)) for name, value in merged.items()
    })
    return done.withColumn("severity", worst_severity("recommendations")).select(
        *offline.columns
    )
