"""SQL for DuckDB that computes the log lines and their entries from the given tables.

These texts check the Spark operators; they are written from the meaning of the operators and
share only fixed values with them.
"""

from __future__ import annotations

from loomlog.fixed import diagnosis, grammar
from loomlog.fixed.levels import ALIASES, DECORATIONS, LEVELS, SYSLOG_SEVERITY
from loomlog.fixed.rules import RULES
from loomlog.fixed.signatures import GATE_NUMBERS, GATE_WORDS, SIGNATURES
from loomlog.functions.text import WHITESPACE
from loomlog.sources.tables import (
    AS_OF,
    ERROR_SQL,
    LEVEL_SQL,
    MESSAGE_SQL,
    RAW_SQL,
    SECOND_SQL,
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = "".join(c for c in WHITESPACE if c.isascii())
STRIP = f"concat({', '.join(f'chr({ord(c)})' for c in WS)})"

LINES = f"""
ev AS (
  SELECT event_id, user_id, event_type, ts,
    CAST(event_id % 4000 + 10 AS VARCHAR) AS n, CAST(user_id % 6 AS VARCHAR) AS svc,
    {LEVEL_SQL} AS lvl,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_iso,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_sp,
    strftime(ts, '%b %d %H:%M:%S') AS ts_sys,
    strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') AS ts_clf
  FROM events),
spoken AS (SELECT *, {MESSAGE_SQL} AS msg FROM ev),
log_lines AS (
  SELECT event_id AS line_number, concat('svc', svc, '.log') AS source, {RAW_SQL} AS raw
  FROM spoken)"""

SECONDS = f"""
seconds AS (
  SELECT {SECOND_SQL} AS sec, count(*) AS n,
    CAST(count(*) FILTER (WHERE {ERROR_SQL}) AS BIGINT) AS err
  FROM events GROUP BY 1)"""


def alias_level(word: str) -> str:
    cases = " ".join(f"WHEN {q(a)} THEN {LEVELS[n]}" for a, n in ALIASES.items())
    return f"(CASE {word} {cases} END)"


def lookup_level(token: str) -> str:
    return alias_level(f"trim(upper({token}), {q(DECORATIONS)})")


def level_name(level: str) -> str:
    cases = " ".join(f"WHEN {v} THEN {q(n)}" for n, v in LEVELS.items())
    return f"(CASE {level} {cases} END)"


def level_from_text(text: str) -> str:
    word = f"regexp_extract({text}, {q(grammar.LEVEL_ANYWHERE)}, 1)"
    return f"coalesce({alias_level(word)}, 20)"


def has_any(lowered: str, words) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {q(w)})" for w in words) + ")"


def gate(text: str) -> str:
    return f"({has_any(f'lower({text})', GATE_WORDS)} OR regexp_matches({text}, {q(GATE_NUMBERS)}))"


def signature(text: str, signatures=SIGNATURES) -> str:
    cases = []
    for s in sorted(signatures, key=lambda s: -s.severity):
        test = f"regexp_matches({text}, {q(s.pattern)}, '{'i' if s.ignore_case else 'c'}')"
        if s.hints:
            test = f"{has_any(f'lower({text})', s.hints)} AND {test}"
        cases.append(f"WHEN {test} THEN {q(s.name)}")
    return f"(CASE {' '.join(cases)} END)"


def floor_of(name: str, signatures=SIGNATURES) -> str:
    cases = " ".join(f"WHEN {q(s.name)} THEN {max(s.severity // 10 * 10, 20)}" for s in signatures)
    return f"(CASE {name} {cases} END)"


def duration(text: str) -> str:
    return (
        f"(CASE WHEN contains({text}, 'ms') OR contains({text}, 'MS') THEN "
        f"TRY_CAST(regexp_extract({text}, {q(grammar.DURATION_MS)}, 1, 'i') AS BIGINT) END)"
    )


def epoch_of(stamp: str) -> str:
    """Epoch seconds of a timestamp text; naive texts are UTC."""
    year = AS_OF[:4]
    syslog = f"try_strptime(concat('{{}} ', {stamp}), '%Y %b %d %H:%M:%S')"
    this, last = syslog.format(year), syslog.format(int(year) - 1)
    clean = f"replace({stamp}, ',', '.')"
    day = r"\d{4}-\d{2}-\d{2}"
    iso = f"^{day}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.,]\\d+)?)?)?$"
    zulu = f"^{day}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}([.,]\\d+)?Z$"
    offset = f"^{day}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}([.,]\\d+)?[+-]\\d{{2}}:\\d{{2}}$"
    return f"""coalesce(CASE
      WHEN regexp_matches({stamp}, '^[A-Z][a-z]{{2}} +\\d{{1,2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') THEN
        epoch_us(CASE WHEN {this} > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY
                 THEN {last} ELSE {this} END) / 1000000.0
      WHEN regexp_matches({stamp}, {q(iso)})
        THEN epoch_us(TRY_CAST({clean} AS TIMESTAMP)) / 1000000.0
      WHEN regexp_matches({stamp}, {q(zulu)})
        THEN epoch_us(TRY_CAST(rtrim({clean}, 'Z') AS TIMESTAMP)) / 1000000.0
      WHEN regexp_matches({stamp}, {q(offset)})
        THEN epoch_us(TRY_CAST({clean} AS TIMESTAMPTZ)) / 1000000.0
      WHEN regexp_matches({stamp}, '^\\d{{1,2}}/[A-Za-z]{{3}}/\\d{{4}}:')
        THEN epoch(try_strptime({stamp}, '%d/%b/%Y:%H:%M:%S %z'))
      WHEN regexp_matches({stamp}, '^\\d{{4}}/')
        THEN epoch(try_strptime({stamp}, '%Y/%m/%d %H:%M:%S'))
      WHEN regexp_matches({stamp}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}} ')
        THEN epoch(try_strptime({stamp}, '%m/%d/%Y %H:%M:%S')) END, 0.0)"""


# -- JSON -----------------------------------------------------------------------------------


def _kind(key: str) -> str:
    return f"json_type(js, {q('$.' + _quoted(key))})"


def _text(key: str) -> str:
    return f"json_extract_string(js, {q('$.' + _quoted(key))})"


def _quoted(key: str) -> str:
    return f'"{key}"'


def _truthy(key: str) -> str:
    return (
        f"(CASE {_kind(key)} WHEN 'VARCHAR' THEN {_text(key)} <> '' "
        f"WHEN 'BOOLEAN' THEN {_text(key)} = 'true' "
        f"WHEN 'OBJECT' THEN {_text(key)} <> '{{}}' WHEN 'ARRAY' THEN {_text(key)} <> '[]' "
        f"WHEN 'NULL' THEN false ELSE TRY_CAST({_text(key)} AS DOUBLE) <> 0 END)"
    )


def _shown(key: str) -> str:
    return (
        f"(CASE {_kind(key)} WHEN 'BOOLEAN' THEN "
        f"CASE {_text(key)} WHEN 'true' THEN 'True' ELSE 'False' END "
        f"WHEN 'DOUBLE' THEN CAST(CAST({_text(key)} AS DOUBLE) AS VARCHAR) ELSE {_text(key)} END)"
    )


def _scalar(keys) -> str:
    found = ", ".join(
        f"CASE WHEN {_kind(k)} NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN {_shown(k)} END"
        for k in keys
    )
    return f"coalesce({found})"


def _first_truthy(keys) -> str:
    return f"coalesce({', '.join(f'CASE WHEN {_truthy(k)} THEN {_shown(k)} END' for k in keys)}, '')"


def _json_level() -> str:
    numbers = ", ".join(str(v) for v in LEVELS.values())
    stated = ", ".join(
        f"CASE WHEN {_truthy(k)} THEN CASE {_kind(k)} "
        f"WHEN 'VARCHAR' THEN coalesce({lookup_level(_text(k))}, 20) WHEN 'BOOLEAN' THEN 1 "
        f"WHEN 'DOUBLE' THEN 20 WHEN 'OBJECT' THEN 20 WHEN 'ARRAY' THEN 20 "
        f"ELSE CASE WHEN TRY_CAST({_text(k)} AS INT) IN ({numbers}) "
        f"THEN TRY_CAST({_text(k)} AS INT) ELSE 20 END END END"
        for k in grammar.JSON_LEVEL_KEYS
    )
    severity = " ".join(
        f"WHEN {n} THEN {LEVELS[name]}" for n, name in SYSLOG_SEVERITY.items()
    )
    return (
        f"coalesce(CASE {_kind('severity')} WHEN 'BOOLEAN' THEN 60 "
        f"WHEN 'UBIGINT' THEN CASE TRY_CAST({_text('severity')} AS INT) {severity} END END, "
        f"{stated}, 20)"
    )


# -- entries --------------------------------------------------------------------------------

_WORDS = "|".join(ALIASES)
_DECOR = r"[\[\]()<>:\-,]*"
_TOKEN = rf"^(?:[^ ]* ){{0,3}}?{_DECOR}({_WORDS}){_DECOR}(?:$| (.*)$)"
_LATE = rf"^(?:[^ ]* ){{3}}{_DECOR} {_DECOR}({_WORDS}){_DECOR}$"
_TAG = grammar.ENCLOSED_TAG


def _g(text: str, pattern: str, n: int, flag: str = "c") -> str:
    return f"regexp_extract({text}, {q(pattern)}, {n}, '{flag}')"


def _inner(tag: str) -> str:
    return f"trim(substr({tag}, 2, length({tag}) - 2), {STRIP})"


def _after_tag(text: str) -> str:
    return f"ltrim(regexp_replace({text}, {q(_TAG)}, ''), {q(grammar.TAG_SEPARATORS)})"


def entries(lines: str = "log_lines", signatures=SIGNATURES) -> str:
    """CTEs that end in ``entries``, one row per line of the named relation."""
    return f"""
e0 AS (
  SELECT *, left(raw, 1) AS head, trim(raw, {STRIP}) AS bare,
    left(raw, 1) BETWEEN '0' AND '9' AS is_digit,
    regexp_matches(left(raw, 1), '[A-Za-z]') AS is_letter
  FROM {lines}),
e1 AS (
  SELECT *, CASE
    WHEN bare = '' THEN 'blank'
    WHEN left(bare, 1) = '{{' AND json_valid(bare) THEN 'json'
    WHEN is_digit AND regexp_matches(raw, {q(grammar.ACCESS_LINE)}) THEN 'access'
    WHEN is_digit AND regexp_matches(raw, {q(grammar.ISO_LINE)}) THEN 'iso'
    WHEN head = '[' AND regexp_matches(raw, {q(grammar.BRACKET_LINE)}) THEN 'bracket'
    WHEN is_letter AND regexp_matches(raw, {q(grammar.SYSLOG_LINE)}) THEN 'syslog'
    WHEN regexp_matches(raw, {q(grammar.LOOSE_LINE)}, 'i') THEN 'loose'
    ELSE 'plain' END AS format
  FROM e0),
e2 AS (
  SELECT *,
    CASE WHEN format = 'json' THEN bare ELSE '{{}}' END AS js,
    CASE format WHEN 'access' THEN {_g('raw', grammar.ACCESS_LINE, 2)}
      WHEN 'iso' THEN {_g('raw', grammar.ISO_LINE, 1)}
      WHEN 'bracket' THEN {_g('raw', grammar.BRACKET_LINE, 1)}
      WHEN 'syslog' THEN {_g('raw', grammar.SYSLOG_LINE, 1)}
      WHEN 'loose' THEN {_g('raw', grammar.LOOSE_LINE, 1, 'i')} ELSE '' END AS stamp,
    CASE format WHEN 'iso' THEN {_g('raw', grammar.ISO_LINE, 2)}
      WHEN 'bracket' THEN {_g('raw', grammar.BRACKET_LINE, 3)}
      WHEN 'syslog' THEN {_g('raw', grammar.SYSLOG_LINE, 5)}
      WHEN 'loose' THEN {_g('raw', grammar.LOOSE_LINE, 3, 'i')} ELSE '' END AS rest,
    CASE format WHEN 'bracket' THEN {_g('raw', grammar.BRACKET_LINE, 2)}
      WHEN 'loose' THEN {_g('raw', grammar.LOOSE_LINE, 2, 'i')} ELSE '' END AS word,
    CASE WHEN format = 'syslog' THEN {_g('raw', grammar.SYSLOG_LINE, 2)} END AS sys_host,
    CASE WHEN format = 'syslog' THEN {_g('raw', grammar.SYSLOG_LINE, 3)} END AS tag,
    CASE WHEN format = 'syslog' THEN nullif({_g('raw', grammar.SYSLOG_LINE, 4)}, '') END AS sys_pid,
    CASE WHEN format = 'access' THEN {_g('raw', grammar.ACCESS_LINE, 1)} END AS ip,
    CASE WHEN format = 'access' THEN {_g('raw', grammar.ACCESS_LINE, 3)} END AS method,
    CASE WHEN format = 'access' THEN {_g('raw', grammar.ACCESS_LINE, 4)} END AS path,
    CASE WHEN format = 'access' THEN CAST({_g('raw', grammar.ACCESS_LINE, 6)} AS INT) END AS status_code,
    CASE WHEN format = 'access' THEN TRY_CAST({_g('raw', grammar.ACCESS_LINE, 7)} AS BIGINT) END AS bytes
  FROM e1),
e3 AS MATERIALIZED (
  SELECT *,
    CASE WHEN format = 'iso' THEN {_inner(_g('rest', _TAG, 1))} ELSE '' END AS tag1,
    CASE WHEN format = 'json' THEN {_json_level()} END AS js_level,
    CASE WHEN format = 'json' THEN {_scalar(grammar.JSON_MESSAGE_KEYS)} END AS js_message,
    CASE WHEN format = 'json' THEN {_scalar(grammar.JSON_TIME_KEYS)} END AS js_stamp,
    CASE WHEN format = 'json' THEN {_first_truthy(grammar.JSON_HOST_KEYS)} END AS js_host,
    CASE WHEN format = 'json' THEN {_first_truthy(grammar.JSON_LOGGER_KEYS)} END AS js_logger,
    CASE WHEN format = 'json' THEN {_first_truthy(['pid'])} END AS js_pid
  FROM e2),
e4 AS (
  SELECT *, CASE WHEN tag1 <> '' THEN {_after_tag('rest')} ELSE rest END AS rest1,
    {lookup_level('tag1')} AS level1
  FROM e3),
e5 AS (
  SELECT *, CASE WHEN tag1 <> '' THEN {_inner(_g('rest1', _TAG, 1))} ELSE '' END AS tag2 FROM e4),
e6 AS (SELECT *, {lookup_level('tag2')} AS level2 FROM e5),
e7 AS MATERIALIZED (
  SELECT *,
    CASE WHEN tag1 <> '' AND level1 IS NULL THEN tag1
      WHEN tag1 <> '' AND tag2 <> '' THEN tag2 END AS src,
    CASE WHEN format = 'syslog'
      THEN {alias_level(f"upper(trim(tag, {q(grammar.TOKEN_DECORATIONS)}))")}
      ELSE coalesce(level1, level2) END AS stated,
    CASE WHEN format = 'iso' THEN
        CASE WHEN tag2 <> '' AND (level1 IS NOT NULL OR level2 IS NOT NULL)
          THEN {_after_tag('rest1')} ELSE rest1 END
      WHEN format = 'syslog' THEN rest END AS body
  FROM e6),
e8 AS (
  SELECT *,
    CASE WHEN stated IS NULL THEN {_g('body', _TOKEN, 1, 'i')} ELSE '' END AS tok,
    CASE WHEN stated IS NULL THEN {_g('body', _LATE, 1, 'i')} ELSE '' END AS late
  FROM e7),
e9 AS MATERIALIZED (
  SELECT *,
    CASE WHEN format IN ('iso', 'syslog') THEN coalesce(stated,
        {alias_level("upper(CASE WHEN tok <> '' THEN tok ELSE late END)")},
        {level_from_text('body')})
      WHEN format = 'json' THEN js_level
      WHEN format = 'access' THEN CASE WHEN status_code >= 500 THEN 40
        WHEN status_code >= 400 THEN 30 WHEN status_code >= 300 THEN 20 ELSE 10 END
      WHEN format IN ('bracket', 'loose') THEN coalesce({lookup_level('word')}, 20)
      WHEN format = 'blank' THEN 20
      ELSE {level_from_text('raw')} END AS level0,
    CASE WHEN format IN ('iso', 'syslog') THEN
        CASE WHEN tok <> '' THEN ltrim({_g('body', _TOKEN, 2, 'i')}, {STRIP})
          WHEN late <> '' THEN '' ELSE body END
      WHEN format = 'json' THEN coalesce(nullif(js_message, ''), bare)
      WHEN format = 'access' THEN trim(concat(method, ' ', path, ' -> ', status_code), {STRIP})
      WHEN format IN ('bracket', 'loose')
        THEN trim(CASE WHEN rest <> '' THEN rest ELSE raw END, {STRIP})
      WHEN format = 'blank' THEN '' ELSE raw END AS message0,
    CASE WHEN format = 'json' THEN coalesce(js_stamp, '')
      WHEN format = 'loose' AND head <> '[' THEN left(trim(stamp, {STRIP}), 80)
      WHEN format IN ('bracket', 'loose') THEN trim(stamp, {STRIP})
      ELSE stamp END AS timestamp,
    CASE format
      WHEN 'json' THEN coalesce(nullif(js_host, ''), nullif(js_logger, ''), source)
      WHEN 'iso' THEN coalesce(src, source) WHEN 'syslog' THEN sys_host
      WHEN 'access' THEN coalesce(nullif(source, ''), ip) ELSE source END AS source1
  FROM e8),
e10 AS (
  SELECT *,
    CASE WHEN message0 = '' AND format <> 'blank' THEN raw ELSE message0 END AS message1,
    {epoch_of(f"trim(timestamp, {STRIP})")} AS ts_epoch
  FROM e9),
e11 AS (SELECT *, CASE WHEN level0 >= 30 THEN message1 ELSE raw END AS txt FROM e10),
e12 AS (SELECT *, format <> 'blank' AND {gate('txt')} AS gated FROM e11),
e13 AS MATERIALIZED (
  SELECT *, format <> 'blank' AND (level0 >= 30 OR gated) AS examined,
    CASE WHEN gated THEN {signature('txt', signatures)} END AS sig
  FROM e12),
entries AS MATERIALIZED (
  SELECT line_number, source1 AS source, raw, format, timestamp, ts_epoch,
    message1 AS message, src, tag, ip, method, path, status_code, bytes, file,
    coalesce(nullif(js_host, ''), sys_host) AS host, nullif(js_logger, '') AS logger,
    coalesce(nullif(js_pid, ''), sys_pid) AS pid,
    level, {level_name('level')} AS level_name, level >= 40 AS is_error,
    CASE WHEN examined THEN coalesce(sig,
        CASE WHEN status_code >= 500 THEN 'http_5xx' WHEN status_code >= 400 THEN 'http_4xx' END,
        '')
      WHEN format = 'blank' THEN '' ELSE concat('ok:', {level_name('level0')}) END AS fingerprint,
    CASE WHEN examined THEN {duration('txt')} END AS duration_ms
  FROM (SELECT *, source AS file,
      CASE WHEN examined
        THEN greatest(level0, {level_from_text('txt')}, coalesce({floor_of('sig', signatures)}, 0))
        ELSE level0 END AS level
    FROM e13))"""


def with_entries(select: str, lines: str = LINES, relation: str = "log_lines", **kw) -> str:
    return f"WITH {lines},{entries(relation, **kw)}\n{select}"


def with_lines(select: str) -> str:
    return f"WITH {LINES}\n{select}"


def with_seconds(select: str, more: str = "") -> str:
    return f"WITH {SECONDS}{more}\n{select}"


# -- rules ----------------------------------------------------------------------------------


def rule_hits(text: str, rules=RULES) -> str:
    """A list of (score, len, place, rule_id, matched), best first."""
    hits = []
    for i, r in enumerate(rules):
        found = ", ".join(
            f"{{'len': length(regexp_extract({text}, {q(p)}, 0, 'i')), 'place': {-j}, "
            f"'matched': regexp_extract({text}, {q(p)}, 0, 'i')}}"
            for j, p in enumerate(r.patterns)
        )
        best = f"list_reverse_sort([{found}])[1]"
        if r.hints:
            best = f"CASE WHEN {has_any(f'lower({text})', r.hints)} THEN {best} END"
        hits.append(
            f"{{'bonus': {r.priority * diagnosis.PRIORITY_WEIGHT}, 'place': {-i}, "
            f"'rule_id': {q(r.rule_id)}, 'best': {best}}}"
        )
    return f"""list_reverse_sort(list_transform(
      list_filter([{', '.join(hits)}], lambda h: h.best.len > 0),
      lambda h: {{'score': h.best.len + h.bonus, 'len': h.best.len, 'place': h.place,
                  'rule_id': h.rule_id, 'matched': h.best.matched}}))"""


def rule_field(rule_id: str, field: str, rules=RULES) -> str:
    cases = " ".join(f"WHEN {q(r.rule_id)} THEN {q(getattr(r, field))}" for r in rules)
    return f"(CASE {rule_id} {cases} END)"


def severity_of(text: str) -> str:
    tiers = " ".join(
        f"WHEN {has_any(f'lower({text})', words)} THEN {q(name)}"
        for name, words in diagnosis.SEVERITY_WORDS
    )
    return f"(CASE {tiers} ELSE 'low' END)"
