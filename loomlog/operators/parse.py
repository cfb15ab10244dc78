"""Log lines -> typed entries.

``parse_logs`` is a chain of narrow projections: no shuffle, no Python worker. Each step
adds the columns the next one needs, so a regular expression runs once per row and only on
rows of its format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.fixed import grammar
from loomlog.fixed.levels import ALIASES, DEFAULT_LEVEL, ERROR, LEVELS, SYSLOG_SEVERITY, WARN
from loomlog.fixed.signatures import (
    ACCESS_CLIENT_ERROR,
    ACCESS_SERVER_ERROR,
    HEALTHY_PREFIX,
    SIGNATURES,
    Signature,
)
from loomlog.functions.levels import (
    alias_level_sql,
    level_from_text_sql,
    level_name_sql,
    lookup_level_sql,
    parse_level_sql,
)
from loomlog.functions.text import group_sql, lstrip_sql, pieces_sql, quoted, strip_sql
from loomlog.functions.timestamps import with_epoch
from loomlog.operators.classify import (
    classify,
    duration_sql,
    error_gate_sql,
    severity_floor_sql,
    signature_sql,
)

ENTRY_COLUMNS = (
    "raw", "source", "line_number", "level", "level_name", "timestamp", "message",
    "ts_epoch", "event_time", "fingerprint", "is_error", "format", "duration_ms",
    "host", "logger", "pid", "tag", "src", "ip", "status_code", "bytes", "method", "path",
    "meta",
)

_ALIAS_WORDS = "|".join(ALIASES)
_DECOR = r"[\[\]()<>:\-,]*"
# A level word among the first four space-separated tokens, and what follows it.
_LEVEL_TOKEN = rf"^(?:[^ ]* ){{0,3}}?{_DECOR}({_ALIAS_WORDS}){_DECOR}(?:$| (.*)$)"
# The fifth piece is looked at only if the fourth token is nothing but decoration.
_LATE_LEVEL_TOKEN = rf"^(?:[^ ]* ){{3}}{_DECOR} {_DECOR}({_ALIAS_WORDS}){_DECOR}$"
_TAGGED = grammar.ENCLOSED_TAG + r"[ \t:|\-–—]*(.*)$"


def _add(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns given as SQL text; an existing name is replaced."""
    kept = [c for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in columns.items()])


def _apart(sql: str) -> str:
    """The same value through a lambda. Spark does not fuse a projection that holds one with
    its neighbours, which bounds the size of the fused methods: HotSpot compiles none above
    8000 bytes, and a parse in one piece would be interpreted."""
    return f"get(transform(array({sql}), v -> v), 0)"


# -- JSON ---------------------------------------------------------------------------------


# Truth of a value, its text form, and the level it names. Booleans are capitalised and whole
# floats keep one decimal; a DECIMAL of scale 0 that would fit a BIGINT can only have been
# written with a fraction.
_TRUTHY = """CASE WHEN v.kind = 'STRING' THEN v.text <> ''
 ELSE v.text NOT IN ('false', '0', '0.0', '-0.0', '[]', '{}') END"""
_SCALAR = "NOT (startswith(v.kind, 'ARRAY') OR startswith(v.kind, 'OBJECT'))"
_SHOWN = r"""CASE WHEN v.kind = 'BOOLEAN' THEN initcap(v.text)
 WHEN v.kind RLIKE '^DECIMAL[(]([0-9]|1[0-8]),0[)]$' THEN concat(v.text, '.0') ELSE v.text END"""
_STATED_LEVEL = f"""CASE
 WHEN v.kind = 'STRING' THEN {parse_level_sql('v.text')}
 WHEN v.kind = 'BIGINT' AND v.text IN ({', '.join(f"'{n}'" for n in LEVELS.values())})
   THEN CAST(v.text AS INT)
 WHEN v.kind = 'BOOLEAN' THEN {LEVELS['TRACE']} ELSE {DEFAULT_LEVEL} END"""
_SYSLOG_LEVEL = f"""CASE
 WHEN v.kind = 'BIGINT' THEN try_element_at(
   map({', '.join(f"'{n}', {LEVELS[name]}" for n, name in SYSLOG_SEVERITY.items())}), v.text)
 WHEN v.kind = 'BOOLEAN' THEN {LEVELS['FATAL']} END"""


def _first_value(keys: Sequence[str], keep: str, show: str, source: str = "_json") -> str:
    """SQL for the first value of some keys that passes ``keep``, as ``show``.

    Arrays and lambdas keep the generated code small, whatever the key lists.
    """
    found = ", ".join(f"try_element_at({source}, {quoted(k)})" for k in keys)
    return f"""get(transform(filter(transform(
      filter(array({found}), v -> v IS NOT NULL),
      v -> struct(schema_of_variant(v) AS kind, try_cast(v AS STRING) AS text)),
      v -> v.text IS NOT NULL AND {keep}), v -> {show}), 0)"""


def _json_pieces() -> dict[str, str]:
    level_keys = _first_value(grammar.JSON_LEVEL_KEYS, _TRUTHY, _STATED_LEVEL)
    severity = _first_value(["severity"], "true", _SYSLOG_LEVEL)
    pid = _first_value(["pid"], _TRUTHY, _SHOWN)
    process_id = _first_value(["id"], _TRUTHY, _SHOWN, "_process")
    pieces = {
        "_json_level": f"coalesce({severity}, {level_keys}, {DEFAULT_LEVEL})",
        "_json_message": _first_value(grammar.JSON_MESSAGE_KEYS, _SCALAR, _SHOWN),
        "_json_stamp": _first_value(grammar.JSON_TIME_KEYS, _SCALAR, _SHOWN),
        "_json_host": _first_value(grammar.JSON_HOST_KEYS, _TRUTHY, _SHOWN),
        "logger": _first_value(grammar.JSON_LOGGER_KEYS, _TRUTHY, _SHOWN),
        "_json_pid": f"coalesce({pid}, {process_id})",
    }
    return {
        name: f"CASE WHEN _format = 'json' THEN {sql} END" for name, sql in pieces.items()
    }


# -- the projection chain -------------------------------------------------------------------


_DIGIT = "substring(raw, 1, 1) BETWEEN '0' AND '9'"
_LETTER = (
    "(substring(raw, 1, 1) BETWEEN 'A' AND 'Z' OR substring(raw, 1, 1) BETWEEN 'a' AND 'z')"
)
_ONE_LINE = "NOT contains(raw, '\\n')"


def _detect(df: DataFrame) -> DataFrame:
    """The format of each line and its pieces.

    The first character decides which pattern is tried; what fails is read loosely.
    """
    lead = f"substring({lstrip_sql('raw')}, 1, 1)"
    access = pieces_sql("raw", grammar.ACCESS_LINE, (1, 2, 3, 4, 6, 7))
    iso = pieces_sql("raw", grammar.ISO_LINE, (1, 2))
    bracket = pieces_sql("raw", grammar.BRACKET_LINE, (1, 2, 3))
    syslog = pieces_sql("raw", grammar.SYSLOG_LINE, (1, 2, 3, 4, 5))
    loose = pieces_sql("raw", grammar.LOOSE_LINE, (1, 2, 3), ignore_case=True)
    df = _add(
        df,
        _blank=f"{lead} = ''",
        _json=f"CASE WHEN {lead} = '{{' "
              f"THEN CAST(try_parse_json({strip_sql('raw')}) AS map<string,variant>) END",
        _access=f"CASE WHEN {_DIGIT} AND contains(raw, 'HTTP/') AND {_ONE_LINE} THEN {access} END",
    )
    df = _add(df, _head=f"""CASE
      WHEN {_DIGIT} AND coalesce(size(_access) = 1, true) THEN {iso}
      WHEN startswith(raw, '[') AND {_ONE_LINE} THEN {bracket}
      WHEN {_LETTER} THEN {syslog} END""")
    df = _add(df, _loose=f"""CASE WHEN NOT (_blank OR _json IS NOT NULL
        OR coalesce(size(_access) > 1, false) OR coalesce(size(_head) > 1, false))
      THEN {loose} END""")
    return _add(df, _format=f"""CASE WHEN _blank THEN 'blank'
      WHEN _json IS NOT NULL THEN 'json'
      WHEN size(_access) > 1 THEN 'access'
      WHEN size(_head) > 1 THEN CASE WHEN {_DIGIT} THEN 'iso' WHEN {_LETTER} THEN 'syslog'
        ELSE 'bracket' END
      WHEN size(_loose) > 1 THEN 'loose' ELSE 'plain' END""")


def _take(**index: int) -> str:
    """SQL: one piece of the line, at a place that depends on its format."""
    holders = {"access": "_access", "loose": "_loose"}
    cases = " ".join(
        f"WHEN '{fmt}' THEN get({holders.get(fmt, '_head')}, {n})" for fmt, n in index.items()
    )
    return f"CASE _format {cases} END"


def _extract(df: DataFrame) -> DataFrame:
    """P2 and the named pieces of every format; null where a format has no such piece."""
    df = _add(df, _process="""CASE WHEN _format = 'json'
      THEN try_cast(try_element_at(_json, 'process') AS map<string,variant>) END""")
    return _add(
        df,
        _stamp=_take(iso=0, syslog=0, bracket=0, access=1, loose=0),
        _rest=_take(iso=1, syslog=4, bracket=2, loose=2),
        _word=_take(bracket=1, loose=1),
        tag=_take(syslog=2),
        ip=_take(access=0),
        method=_take(access=2),
        path=_take(access=3),
        status_code=f"CAST({_take(access=4)} AS INT)",
        bytes=f"try_cast(nullif({_take(access=5)}, '-') AS BIGINT)",
        _syslog_host=_take(syslog=1),
        _syslog_pid=f"nullif({_take(syslog=3)}, '')",
        **_json_pieces(),
    )


def _split_tag(text: str) -> str:
    """SQL: a leading ``[..]``, ``(..)`` or ``<..>`` and the text after it."""
    return f"""CASE WHEN substring({lstrip_sql(text)}, 1, 1) IN ('[', '(', '<')
      THEN {pieces_sql(text, _TAGGED, (1, 2))} END"""


def _inner(parts: str) -> str:
    tag = f"get({parts}, 0)"
    return f"""CASE WHEN size({parts}) > 1
      THEN {strip_sql(f'substring({tag}, 2, length({tag}) - 2)')} END"""


def _tags(df: DataFrame) -> DataFrame:
    """P5: up to two leading tags; one may name the level, the other the source.

    The second tag is left in the text if the first named a source and it names no level.
    """
    df = _add(df, _parts1=f"CASE WHEN _format = 'iso' THEN {_split_tag('_rest')} END")
    df = _add(df, _tag1=_inner("_parts1"))
    df = _add(df, _rest1="CASE WHEN _tag1 <> '' THEN get(_parts1, 1) ELSE _rest END")
    df = _add(
        df,
        _level1=lookup_level_sql("_tag1"),
        _parts2=f"CASE WHEN _tag1 <> '' THEN {_split_tag('_rest1')} END",
    )
    df = _add(df, _tag2=_inner("_parts2"))
    df = _add(df, _level2=lookup_level_sql("_tag2"))
    bare_tag = f"upper(btrim(tag, {quoted(grammar.TOKEN_DECORATIONS)}))"
    return _add(
        df,
        _stated=f"CASE WHEN _format = 'syslog' THEN {alias_level_sql(bare_tag)} "
                "ELSE coalesce(_level1, _level2) END",
        src="""CASE WHEN _tag1 <> '' AND _level1 IS NULL THEN _tag1
          WHEN _tag1 <> '' AND _tag2 <> '' THEN _tag2 END""",
        _body=_apart("""CASE _format WHEN 'syslog' THEN _rest WHEN 'iso' THEN CASE
          WHEN _tag2 <> '' AND (_level1 IS NOT NULL OR _level2 IS NOT NULL) THEN get(_parts2, 1)
          ELSE _rest1 END END"""),
    )


def _level_tokens(df: DataFrame) -> DataFrame:
    """A level word among the first tokens; it and all before it leave the message."""
    token = pieces_sql("_body", _LEVEL_TOKEN, (1, 2), ignore_case=True)
    late = group_sql("_body", _LATE_LEVEL_TOKEN, 1, ignore_case=True)
    df = _add(df, _token=f"CASE WHEN _body IS NOT NULL AND _stated IS NULL THEN {token} END")
    df = _add(df, _late=f"CASE WHEN size(_token) = 1 THEN nullif({late}, '') END")
    word = "upper(CASE WHEN size(_token) > 1 THEN get(_token, 0) ELSE _late END)"
    return _add(
        df,
        _body_level=f"CASE WHEN _body IS NOT NULL THEN coalesce(_stated, "
                    f"{alias_level_sql(word)}, {level_from_text_sql('_body')}) END",
        _body_message=f"""CASE WHEN size(_token) > 1 THEN {lstrip_sql('get(_token, 1)')}
          WHEN _late IS NOT NULL THEN '' ELSE _body END""",
    )


def _assemble(df: DataFrame) -> DataFrame:
    """Level, message, timestamp text and source, before classification."""
    access_level = f"""CASE WHEN status_code >= 500 THEN {LEVELS['ERROR']}
      WHEN status_code >= 400 THEN {LEVELS['WARN']}
      WHEN status_code >= 300 THEN {LEVELS['INFO']} ELSE {LEVELS['DEBUG']} END"""
    said = """CASE WHEN _format = 'access' THEN concat(method, ' ', path, ' -> ', status_code)
      WHEN _rest <> '' THEN _rest ELSE raw END"""
    return _add(
        df,
        host="coalesce(_json_host, _syslog_host)",
        pid="coalesce(_json_pid, _syslog_pid)",
        _level=f"""CASE WHEN _format IN ('iso', 'syslog') THEN _body_level
          WHEN _format = 'json' THEN _json_level
          WHEN _format = 'access' THEN {access_level}
          WHEN _format IN ('bracket', 'loose') THEN {parse_level_sql('_word')}
          WHEN _format = 'blank' THEN {DEFAULT_LEVEL}
          ELSE {level_from_text_sql('raw')} END""",
        _message=f"""CASE WHEN _format IN ('iso', 'syslog') THEN _body_message
          WHEN _format = 'json' THEN coalesce(nullif(_json_message, ''), {strip_sql('raw')})
          WHEN _format = 'blank' THEN ''
          WHEN _format = 'plain' THEN raw
          ELSE {strip_sql(said)} END""",
        # a bracketed line that is only loosely readable keeps its whole prefix
        timestamp=f"""CASE WHEN _format = 'json' THEN coalesce(_json_stamp, '')
          WHEN _format = 'loose' AND NOT startswith(raw, '[')
            THEN substring({strip_sql('_stamp')}, 1, {grammar.LOOSE_PREFIX_CHARS})
          WHEN _format IN ('bracket', 'loose') THEN {strip_sql('_stamp')}
          ELSE coalesce(_stamp, '') END""",
        source="""CASE _format WHEN 'json' THEN coalesce(_json_host, logger, source)
          WHEN 'iso' THEN coalesce(src, source) WHEN 'syslog' THEN _syslog_host
          WHEN 'access' THEN coalesce(nullif(source, ''), ip) ELSE source END""",
    )


def _enrich(df: DataFrame, signatures: Sequence[Signature], as_of: Column | None) -> DataFrame:
    """Epoch, signature, level raise. A level is only ever raised."""
    df = _add(
        df,
        message="CASE WHEN _message = '' AND _format <> 'blank' THEN raw ELSE _message END",
        _stamp=_apart(strip_sql("timestamp")),
    )
    df = _add(df, _text=f"CASE WHEN _level >= {WARN} THEN message ELSE raw END")
    df = with_epoch(df, "_stamp", "ts_epoch", as_of)
    df = _add(df, _lowered=_apart("lower(_text)"))
    df = _add(df, _gate=f"_format <> 'blank' AND {error_gate_sql('_text', '_lowered')}")
    df = _add(
        df,
        _examined=f"_format <> 'blank' AND (_level >= {WARN} OR _gate)",
        _signature=_apart(
            f"CASE WHEN _gate THEN {signature_sql('_text', '_lowered', signatures)} END"
        ),
    )
    df = _add(df, level=f"""CASE WHEN _examined THEN greatest(_level,
        {level_from_text_sql('_text')}, {severity_floor_sql('_signature', signatures)})
      ELSE _level END""")
    return _add(
        df,
        level_name=level_name_sql("level"),
        is_error=f"level >= {ERROR}",
        fingerprint=f"""CASE WHEN _examined THEN coalesce(_signature,
            CASE WHEN status_code >= 500 THEN '{ACCESS_SERVER_ERROR}'
              WHEN status_code >= 400 THEN '{ACCESS_CLIENT_ERROR}' END, '')
          WHEN _format = 'blank' THEN ''
          ELSE concat('{HEALTHY_PREFIX}', {level_name_sql('_level')}) END""",
        duration_ms=f"CASE WHEN _examined THEN {duration_sql('_text')} END",
        event_time="""CASE WHEN ts_epoch > 0
          THEN timestamp_micros(CAST(round(ts_epoch * 1000000) AS BIGINT)) END""",
    )


def _meta() -> str:
    """Open attributes. Empty ones are left out, except the fixed set of access lines."""

    def text_map(*names: str) -> str:
        return f"map({', '.join(f'{quoted(n)}, CAST({n} AS STRING)' for n in names)})"

    def filled(pairs: str) -> str:
        return f"map_filter({pairs}, (k, v) -> v IS NOT NULL AND v <> '')"

    duration = "CASE WHEN duration_ms IS NULL THEN map() ELSE " + text_map("duration_ms") + " END"
    return f"""map_concat(CASE _format
      WHEN 'json' THEN {filled(text_map('host', 'logger', 'pid'))}
      WHEN 'iso' THEN {filled(text_map('src'))}
      WHEN 'syslog' THEN {filled(text_map('host', 'tag', 'pid'))}
      WHEN 'access' THEN {text_map('ip', 'status_code', 'bytes', 'method', 'path')}
      ELSE CAST(map() AS map<string,string>) END, CAST({duration} AS map<string,string>))"""


def parse_logs(
    df: DataFrame,
    *,
    columns: Sequence[str] = ENTRY_COLUMNS,
    as_of: Column | None = None,
    signatures: Sequence[Signature] = SIGNATURES,
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Parse lines ``(raw, source, line_number, ...)`` into entries.

    Other input columns are kept. ``columns`` names the entry columns wanted; the work for
    the rest is then left out. ``signatures`` replaces the classification table and ``parse``
    replaces this parser as a whole.

    The entry leaves through ``inline``: Catalyst pushes no filter through a generator, so a
    filter on a parsed column is tested on the finished entry. Pushed below the projections
    it would repeat the whole parse inside the filter. A caller with several uses of the
    entries should write them to a table first.
    """
    if parse is not None:
        return parse(df)
    extra = [c for c in df.columns if c not in ENTRY_COLUMNS]
    if "line_number" not in df.columns:
        df = df.withColumn("line_number", F.lit(0).cast("bigint"))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(""))
    for step in (_detect, _extract, _tags, _level_tokens, _assemble):
        df = step(df)
    df = _enrich(df, signatures, as_of)
    df = _add(df, format="_format", meta=_meta())
    wanted = [c for c in ENTRY_COLUMNS if c in set(columns)]
    return df.selectExpr(f"inline(array(struct({', '.join(wanted)})))", *extra)


def analyze(df: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """P20: entries with a second look at the message, which may raise the level again."""
    staged = classify(df.drop("duration_ms"), "message", signatures).withColumn(
        "level", F.greatest("level", "min_level")
    )
    return staged.selectExpr(
        "source", "line_number", "level", "level AS level_priority",
        f"level >= {ERROR} AS is_error", "level AS max_severity",
        "CASE WHEN fingerprint <> '' THEN array(fingerprint) "
        "ELSE CAST(array() AS array<string>) END AS error_categories",
        "raw", "message", "fingerprint",
    )


def entry_record(df: DataFrame) -> DataFrame:
    """The flat public record of an entry."""
    return df.select(
        "timestamp", "ts_epoch", F.col("level_name").alias("level"), "source", "line_number",
        "message", "raw", "fingerprint", "meta",
    )
