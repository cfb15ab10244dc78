"""Queries over rules, diagnoses, prompts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.fixed import diagnosis as fixed
from loomlog.fixed.rules import RULES, Rule
from loomlog.operators import diagnose as ops
from loomlog.operators.order import with_context
from loomlog.plans import check_base as sql
from loomlog.plans.parsing import parsed, placed_entries
from loomlog.sources.tables import log_lines, spread, table


def _joined(column):
    return F.array_join(column, " | ")


def _list(items):
    return "[" + ", ".join(sql.q(i) for i in items) + "]"


# -- rules --------------------------------------------------------------------------------------


def rule_hits(spark, sf_dir):
    found = ops.match_rules(log_lines(spark, sf_dir))
    shown = F.transform("hits", lambda h: F.concat(h["rule_id"], F.lit(":"), h["matched"]))
    return found.select("line_number", _joined(shown).alias("hits"))


_HITS_SHOWN = "list_transform(hits[1:3], lambda h: concat(h.rule_id, ':', h.matched))"


def _hits(text="raw", rules=RULES, relation="log_lines"):
    return f"hit AS MATERIALIZED (SELECT *, {sql.rule_hits(text, rules)} AS hits FROM {relation})"


def conversation_rules(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations"))
    found = ops.best_rule(turns, "text")
    return found.select("conv_id", "turn", "role", "rule_id", "matched")


def rule_categories(spark, sf_dir):
    """Error lines by diagnosis category."""
    errors = parsed(spark, sf_dir, "raw", "is_error").filter("is_error")
    return ops.category_counts(errors)


def rule_details(spark, sf_dir):
    found = ops.with_rule_details(ops.best_rule(log_lines(spark, sf_dir)))
    return found.select(
        "line_number", "rule_id", "matched", "title", "category", "root_cause", "confidence",
        F.size("checks").alias("checks"),
    )


CUSTOM_RULES = (
    Rule("slow_job", "Slow job", "Batch", "A job ran long.", "low", (r"\bjob \d+\b",), ("job",)),
    Rule("status", "Bad status", "HTTP", "A status was returned.", "medium",
         (r"status \d", r"status \d{3}\b"), None, priority=1),
    Rule("any_error", "Error", "General", "Something failed.", "high",
         (r"\berror\b", r"\bfailed\b"), ("error", "fail")),
)


def custom_rules(spark, sf_dir):
    found = ops.match_rules(log_lines(spark, sf_dir), rules=CUSTOM_RULES, limit=2)
    shown = F.transform("hits", lambda h: F.concat(h["rule_id"], F.lit(":"), h["matched"]))
    return found.select("line_number", _joined(shown).alias("hits"))


# -- diagnoses ----------------------------------------------------------------------------------


def _errors_in_context(spark, sf_dir):
    entries = placed_entries(spark, sf_dir, "line_number", "raw", "is_error")
    return with_context(entries, F.col("is_error"), half=6, position="position")


def _diagnosed(spark, sf_dir):
    return ops.diagnose(_errors_in_context(spark, sf_dir), context="context")


def diagnoses(spark, sf_dir):
    return _diagnosed(spark, sf_dir).select(
        "line_number", "rule_id", "category", "summary", "root_cause", "confidence", "severity",
        _joined("evidence").alias("evidence"), _joined("prevention").alias("prevention"),
        _joined("docs").alias("docs"), F.size("recommendations").cast("bigint").alias("steps"),
        F.size("related_entries").cast("bigint").alias("related"),
    )


def _cases(build, rules=RULES):
    return " ".join(f"WHEN {sql.q(r.rule_id)} THEN {build(r)}" for r in rules)


def _steps_of(rule):
    return "[" + ", ".join(
        f"{{'t': {sql.q(t)}, 'd': {sql.q(d)}, 'c': {sql.q(c)}, 's': sev}}" for t, d, c in rule.checks
    ) + "]"


def _first_step(rule):
    t, d, c = rule.checks[0]
    return f"[{{'t': {sql.q('Also check: ' + t)}, 'd': {sql.q(d)}, 'c': {sql.q(c)}, 's': 'medium'}}]"


_NO_STEPS = "CAST([] AS STRUCT(t VARCHAR, d VARCHAR, c VARCHAR, s VARCHAR)[])"
_UNMATCHED = "[" + ", ".join(
    f"{{'t': {sql.q(t)}, 'd': {sql.q(d)}, 'c': {sql.q(c)}, 's': {sql.q(s)}}}"
    for t, d, c, s in fixed.UNMATCHED_STEPS
) + "]"
_WORDS = "string_split(trim(raw), ' ')"

_DIAGNOSED = f"""ctx AS MATERIALIZED (
  SELECT line_number, raw, context FROM (SELECT line_number, raw, is_error, list(raw) OVER (
      PARTITION BY file ORDER BY line_number ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context
    FROM entries) WHERE is_error),
{_hits(relation='ctx')},
ruled AS (
  SELECT *, hits[1].rule_id AS rule_id, hits[2].rule_id AS second, {sql.severity_of('raw')} AS sev,
    list_transform(list_filter(context, lambda c: regexp_matches(c, {sql.q(fixed.SALIENT_PATTERN)}, 'i'))[-4:],
      lambda c: left(c, 180)) AS salient
  FROM hit),
dx AS MATERIALIZED (
  SELECT *,
    CASE WHEN rule_id IS NULL THEN {_UNMATCHED}
      ELSE list_concat(CASE rule_id {_cases(_steps_of)} END,
        coalesce(CASE second {_cases(_first_step)} END, {_NO_STEPS})) END AS steps,
    CASE WHEN rule_id IS NULL
      THEN list_concat([concat('Input: ', left(raw, 200))], salient)
      ELSE list_concat(list_transform(hits[1:3], lambda h, i: concat(
        CASE WHEN i = 1 THEN 'Matched rule ''' ELSE 'Secondary match ''' END, h.rule_id,
        ''' on: ', h.matched)), salient)[1:8] END AS evidence,
    CASE WHEN rule_id IS NULL THEN {_list(fixed.UNMATCHED_PREVENTION)}
      ELSE CASE rule_id {_cases(lambda r: _list(r.prevention))} END END AS prevention,
    coalesce(CASE rule_id {_cases(lambda r: f"CAST({_list(r.docs)} AS VARCHAR[])")} END,
      CAST([] AS VARCHAR[])) AS docs,
    coalesce({sql.rule_field('rule_id', 'category')}, 'General') AS category,
    CASE WHEN rule_id IS NULL
      THEN left(array_to_string({_WORDS}[1:6], ' '), 80)
      ELSE {sql.rule_field('rule_id', 'title')} END AS summary,
    coalesce({sql.rule_field('rule_id', 'root_cause')}, {sql.q(fixed.UNMATCHED_CAUSE)}) AS root_cause,
    coalesce({sql.rule_field('rule_id', 'confidence')}, 'low') AS confidence
  FROM ruled)"""

_SEVERITY = """CASE list_max(list_transform(steps, lambda s: CASE s.s WHEN 'critical' THEN 3
  WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)) WHEN 3 THEN 'critical' WHEN 2 THEN 'high'
  WHEN 1 THEN 'medium' ELSE 'low' END"""


def _dx(select):
    return f"WITH {sql.LINES},{sql.entries()},\n{_DIAGNOSED}\n{select}"


def recommendations(spark, sf_dir):
    found = ops.recommendation_table(_diagnosed(spark, sf_dir), ["line_number"])
    return found.withColumn("command", F.coalesce("command", F.lit("")))


def preventions(spark, sf_dir):
    return ops.prevention_table(_diagnosed(spark, sf_dir), ["line_number"])


def diagnosis_texts(spark, sf_dir):
    return _diagnosed(spark, sf_dir).select(
        "line_number", F.md5(ops.diagnosis_text()).alias("text_md5")
    )


def _section(title, lines):
    return f"""CASE WHEN len({lines}) > 0 THEN list_concat(['', '{title}'], {lines})
      ELSE CAST([] AS VARCHAR[]) END"""


_TEXTS = _dx(f"""SELECT line_number, md5(array_to_string(list_concat(list_concat(list_concat(list_concat(
  [concat('[', upper(confidence), '] ', summary), 'Source: offline (0 ms)', concat('Root cause: ', root_cause)],
  {_section('Evidence:', "list_transform(evidence[1:6], lambda x: concat('  - ', x))")}),
  {_section('Next steps:', '''flatten(list_transform(steps, lambda r, i: list_filter([
      concat('  ', i, '. ', r.t, '  [', r.s, ']'),
      CASE WHEN r.d <> '' THEN concat('     ', r.d) END,
      CASE WHEN r.c <> '' THEN concat('     $ ', r.c) END], lambda x: x IS NOT NULL)))''')}),
  {_section('Prevention:', "list_transform(prevention, lambda x: concat('  - ', x))")}),
  {_section('References:', "list_transform(docs, lambda x: concat('  - ', x))")}), chr(10))) AS text_md5
FROM dx""")


def prompts(spark, sf_dir):
    found = ops.with_prompt(_errors_in_context(spark, sf_dir), context="context")
    return found.select(
        "line_number", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_md5")
    )


_PROMPTS = _dx(f"""SELECT line_number, length(p) AS chars, md5(p) AS prompt_md5 FROM (
  SELECT line_number, left(array_to_string(list_concat(list_concat(
    [concat('TARGET LOG LINE:', chr(10), raw), 'SURROUNDING LOG LINES:'],
    list_transform(context, lambda c: concat('  ', c))),
    CASE WHEN len(hits) > 0 THEN list_concat(['KNOWN SIGNATURES (verify, do not assume):'],
      list_transform(hits[1:3], lambda h: concat('  - ', h.rule_id, ': matched ''', h.matched, ''' -> ',
        {sql.rule_field('h.rule_id', 'root_cause')}))) ELSE CAST([] AS VARCHAR[]) END), chr(10)), 6000) AS p
  FROM dx)""")


def text_severities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    return docs.select(
        "doc_id", ops.infer_severity("low").alias("severity"),
        ops.generic_title(F.col("text")).alias("title"),
    )


# -- replies --------------------------------------------------------------------------------------

REPLY_SQL = """CASE event_id % 8
 WHEN 0 THEN concat('{"summary":"Pool exhausted ', CAST(event_id AS STRING), '","confidence":"HIGH","root_cause":"Pool too small","evidence":["pool=20",""],"recommendations":[{"title":"Raise pool size","description":"","command":"psql","severity":"High"}],"prevention":["autotune"]}')
 WHEN 1 THEN 'I cannot help with that.'
 WHEN 2 THEN '```json{"summary":"OOM","confidence":"very_high","root_cause":"heap limit","recommendations":[]}```'
 WHEN 3 THEN 'Sure, here it is: {"summary":"x","confidence":"SUPER HIGH","recommendations":["do a thing",7,{"command":"ls"}]} Hope it helps.'
 WHEN 4 THEN '{"summary":"","root_cause":null}'
 WHEN 5 THEN '[1,2,3]'
 WHEN 6 THEN 'broken {"summary": '
 ELSE '{"recommendations":["a","b","c","d","e","f","g","h","i","j"],"evidence":["1","2","3","4","5","6","7","8","9","10","11"],"prevention":["p1","p2","p3","p4","p5","p6","p7","p8","p9"],"confidence":" low "}' END"""


def _replies(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS line_number", "concat('m', user_id % 3) AS provider", f"{REPLY_SQL} AS reply"
    )


def parsed_replies(spark, sf_dir):
    return ops.parse_reply(_replies(spark, sf_dir)).select(
        "line_number", F.col("answer").isNotNull().alias("readable"),
        F.try_variant_get("answer", "$.summary", "string").alias("summary"),
        F.try_variant_get("answer", "$.confidence", "string").alias("confidence"),
    )


_BARE = r"regexp_replace(trim(reply), '^\s*```(?:json)?\s*|\s*```\s*$', '', 'gi')"
_ANSWER = f"""replies AS (SELECT event_id AS line_number, concat('m', user_id % 3) AS provider,
  {REPLY_SQL.replace('STRING', 'VARCHAR')} AS reply FROM events),
bare AS (SELECT *, {_BARE} AS b FROM replies),
cut AS (SELECT *, regexp_extract(b, '\\{{.*\\}}', 0, 's') AS part FROM bare),
answers AS MATERIALIZED (SELECT line_number, provider,
  CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'OBJECT' THEN b END
    WHEN part <> '' AND json_valid(part) THEN part END AS answer FROM cut)"""


def merged_replies(spark, sf_dir):
    """A reply for every error line, merged with its rule evidence."""
    errors = parsed(spark, sf_dir, "line_number", "raw", "is_error").filter("is_error")
    found = ops.merge_replies(errors, _replies(spark, sf_dir), "line_number")
    steps = F.transform(
        "recommendations",
        lambda s: F.concat_ws("/", s["title"], s["description"], s["command"], s["severity"]),
    )
    return found.select(
        "line_number", "provider", "summary", "root_cause", "confidence", "severity",
        _joined("evidence").alias("evidence"), _joined("prevention").alias("prevention"),
        _joined(steps).alias("steps"),
    )


def _backstop(rule):
    return "[" + ", ".join(
        f"{{'t': {sql.q(t)}, 'd': {sql.q(d)}, 'c': {sql.q(c)}, 's': 'medium'}}"
        for t, d, c in rule.checks[:3]
    ) + "]"


_STEP_SHOWN = """list_transform(steps, lambda s: concat_ws('/', s.t, s.d, nullif(s.c, ''), s.s))"""
_MERGED = f"""WITH {sql.LINES},{sql.entries()},
{_DIAGNOSED.replace('PARTITION BY file ORDER BY line_number ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING',
                    'PARTITION BY line_number').replace('list(raw) OVER (', '[] || list(NULL::VARCHAR) OVER (')},
{_ANSWER},
both_ AS (
  SELECT dx.*, provider, answer,
    list_filter(list_transform(
      CASE WHEN json_type(answer, '$.recommendations') = 'ARRAY'
        THEN CAST(json_extract(answer, '$.recommendations') AS JSON[]) ELSE CAST([] AS JSON[]) END,
      lambda r, i: CASE json_type(r)
        WHEN 'VARCHAR' THEN {{'t': concat('Step ', i), 'd': json_extract_string(r, '$'), 'c': '', 's': 'medium'}}
        WHEN 'OBJECT' THEN {{
          't': coalesce(nullif(json_extract_string(r, '$.title'), ''), concat('Step ', i)),
          'd': coalesce(json_extract_string(r, '$.description'), ''),
          'c': coalesce(json_extract_string(r, '$.command'), ''),
          's': lower(coalesce(nullif(json_extract_string(r, '$.severity'), ''), 'medium'))}} END),
      lambda s: s IS NOT NULL) AS given,
    list_filter(CAST(coalesce(json_extract(answer, '$.evidence'), '[]') AS VARCHAR[]), lambda x: x <> '') AS seen,
    list_filter(CAST(coalesce(json_extract(answer, '$.prevention'), '[]') AS VARCHAR[]), lambda x: x <> '') AS avoid,
    lower(trim(coalesce(json_extract_string(answer, '$.confidence'), ''))) AS conf
  FROM dx LEFT JOIN answers USING (line_number)),
done AS (
  SELECT line_number, coalesce(CASE WHEN answer IS NOT NULL THEN provider END, 'offline') AS provider,
    CASE WHEN answer IS NULL THEN summary
      ELSE coalesce(nullif(json_extract_string(answer, '$.summary'), ''), 'Unclassified failure') END AS summary,
    CASE WHEN answer IS NULL THEN root_cause
      ELSE coalesce(nullif(json_extract_string(answer, '$.root_cause'), ''), 'Not determined') END AS root_cause,
    CASE WHEN answer IS NULL THEN confidence
      WHEN conf IN ('low', 'medium', 'high', 'very_high') THEN conf ELSE 'medium' END AS confidence,
    CASE WHEN answer IS NULL THEN evidence ELSE list_concat(seen, list_transform(hits[1:3],
      lambda h: concat('Matched rule ''', h.rule_id, ''' on: ', h.matched)))[1:10] END AS evidence,
    CASE WHEN answer IS NULL THEN prevention WHEN len(avoid) > 0 THEN avoid[1:8]
      ELSE coalesce(CASE rule_id {_cases(lambda r: _list(r.prevention))} END, avoid)[1:8] END AS prevention,
    CASE WHEN answer IS NULL THEN steps WHEN len(given) > 0 THEN given[1:8]
      ELSE coalesce(CASE rule_id {_cases(_backstop)} END, {_NO_STEPS}) END AS steps
  FROM both_)
SELECT line_number, provider, summary, root_cause, confidence, {_SEVERITY} AS severity,
  array_to_string(evidence, ' | ') AS evidence, array_to_string(prevention, ' | ') AS prevention,
  array_to_string({_STEP_SHOWN}, ' | ') AS steps
FROM done"""
# this query gives the diagnosis no surrounding lines
_MERGED = _MERGED.replace(
    "[] || list(NULL::VARCHAR) OVER (\n      PARTITION BY line_number) AS context",
    "CAST([] AS VARCHAR[]) AS context",
)


QUERIES = {
    "rule_hits": (rule_hits, f"WITH {sql.LINES},\n{_hits()}\nSELECT line_number, "
                             f"array_to_string({_HITS_SHOWN}, ' | ') AS hits FROM hit"),
    "conversation_rules": (
        conversation_rules,
        f"WITH {_hits('text', relation='conversations')}\nSELECT conv_id, turn, role, "
        "hits[1].rule_id AS rule_id, hits[1].matched AS matched FROM hit"),
    "rule_categories": (
        rule_categories,
        f"""WITH {sql.LINES},{sql.entries()},
{_hits(relation="(SELECT raw FROM entries WHERE is_error)")}
SELECT coalesce({sql.rule_field('hits[1].rule_id', 'category')}, 'General') AS category, count(*) AS cnt
FROM hit GROUP BY 1"""),
    "rule_details": (
        rule_details,
        f"""WITH {sql.LINES},\n{_hits()}, best AS (SELECT line_number, hits[1].rule_id AS rule_id,
  hits[1].matched AS matched FROM hit)
SELECT *, {sql.rule_field('rule_id', 'title')} AS title, {sql.rule_field('rule_id', 'category')} AS category,
  {sql.rule_field('rule_id', 'root_cause')} AS root_cause,
  {sql.rule_field('rule_id', 'confidence')} AS confidence,
  CASE rule_id {_cases(lambda r: str(len(r.checks)))} END AS checks FROM best"""),
    "custom_rules": (
        custom_rules,
        f"WITH {sql.LINES},\n{_hits(rules=CUSTOM_RULES)}\nSELECT line_number, "
        f"array_to_string({_HITS_SHOWN.replace('1:3', '1:2')}, ' | ') AS hits FROM hit"),
    "diagnoses": (diagnoses, _dx(f"""SELECT line_number, rule_id, category, summary, root_cause,
  confidence, {_SEVERITY} AS severity, array_to_string(evidence, ' | ') AS evidence,
  array_to_string(prevention, ' | ') AS prevention, array_to_string(docs, ' | ') AS docs,
  len(steps) AS steps, least(len(context), 12) AS related FROM dx""")),
    "recommendations": (recommendations, _dx("""SELECT line_number, CAST(i AS INT) AS step_no, s.t AS title,
  s.d AS description, s.c AS command, s.s AS severity
FROM (SELECT line_number, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS i FROM dx)""")),
    "preventions": (preventions, _dx("""SELECT line_number, unnest(prevention) AS hint,
  CAST(unnest(range(1, len(prevention) + 1)) AS INT) AS hint_no FROM dx""")),
    "diagnosis_texts": (diagnosis_texts, _TEXTS),
    "prompts": (prompts, _PROMPTS),
    "text_severities": (text_severities, f"""SELECT doc_id, {sql.severity_of('text')} AS severity,
  coalesce(nullif(left(array_to_string(string_split(trim(text, {sql.STRIP}), ' ')[1:6], ' '), 80), ''),
    'Unclassified log event') AS title FROM documents"""),
    "parsed_replies": (parsed_replies, f"""WITH {_ANSWER}
SELECT line_number, answer IS NOT NULL AS readable, json_extract_string(answer, '$.summary') AS summary,
  json_extract_string(answer, '$.confidence') AS confidence FROM answers"""),
    "merged_replies": (merged_replies, _MERGED),
}
