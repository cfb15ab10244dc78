"""Queries over the parser and the classifier, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.fixed.signatures import Signature
from loomlog.functions.levels import level_name_sql, lookup_level, parse_level_sql
from loomlog.functions.timestamps import with_epoch
from loomlog.operators.classify import classify, duration_sql, error_gate_sql
from loomlog.operators.parse import ENTRY_COLUMNS, analyze, entry_record, parse_logs
from loomlog.operators.order import with_position
from loomlog.plans import check_base as sql
from loomlog.session import shared_folder
from loomlog.sources.tables import as_of, log_lines, spread, table

_KEY = ("line_number", "file")


def parsed(spark, sf_dir, *columns, lines=None, **options):
    """Entries of the log lines; the source as read stays in ``file``."""
    lines = log_lines(spark, sf_dir) if lines is None else lines
    lines = lines.withColumn("file", F.col("source"))
    return parse_logs(lines, columns=columns or ENTRY_COLUMNS, as_of=as_of(), **options)


def stored(spark, entries):
    """Entries as a table: what uses them several times parses them once."""
    path = f"{shared_folder(spark)}/entries"
    entries.write.parquet(path)
    return spark.read.parquet(path)


def placed_entries(spark, sf_dir, *columns):
    """Entries with their position in their source, numbered on the bare lines."""
    placed = with_position(log_lines(spark, sf_dir))
    entries = parsed(spark, sf_dir, *columns, lines=placed)
    return entries.withColumnRenamed("file", "source")


def _format_query(fmt, *columns):
    wanted = ["line_number", "source", *columns]

    def run(spark, sf_dir):
        return parsed(spark, sf_dir, *wanted, "format").filter(F.col("format") == fmt).select(wanted)

    return run, sql.with_entries(
        f"SELECT {', '.join(wanted)} FROM entries WHERE format = '{fmt}'"
    )


_ALL = [c for c in ENTRY_COLUMNS if c not in ("meta", "event_time", "raw")] + ["file"]


def parsed_entries(spark, sf_dir):
    return parsed(spark, sf_dir).select(_ALL)


def format_histogram(spark, sf_dir):
    return parsed(spark, sf_dir, "format").groupBy("format").agg(F.count("*").alias("cnt"))


def entry_meta(spark, sf_dir):
    pairs = F.transform(
        F.array_sort(F.map_entries("meta")),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))),
    )
    return parsed(spark, sf_dir, "line_number", "meta").select(
        "line_number", F.array_join(pairs, ";").alias("meta")
    )


_META = sql.with_entries("""SELECT line_number, array_to_string(list_sort(list_filter([
  CASE WHEN duration_ms IS NOT NULL THEN concat('duration_ms=', duration_ms) END,
  CASE WHEN format IN ('json', 'syslog') AND host <> '' THEN concat('host=', host) END,
  CASE WHEN format = 'json' AND logger <> '' THEN concat('logger=', logger) END,
  CASE WHEN format IN ('json', 'syslog') AND pid <> '' THEN concat('pid=', pid) END,
  CASE WHEN format = 'syslog' AND tag <> '' THEN concat('tag=', tag) END,
  CASE WHEN format = 'iso' AND src <> '' THEN concat('src=', src) END,
  CASE WHEN format = 'access' THEN concat('ip=', ip) END,
  CASE WHEN format = 'access' THEN concat('status_code=', status_code) END,
  CASE WHEN format = 'access' THEN concat('bytes=', coalesce(CAST(bytes AS VARCHAR), '-')) END,
  CASE WHEN format = 'access' THEN concat('method=', method) END,
  CASE WHEN format = 'access' THEN concat('path=', path) END], lambda x: x IS NOT NULL)), ';') AS meta
FROM entries""")

# -- JSON of every value type ---------------------------------------------------------------

JSON_SQL = """
CASE event_id % 12
 WHEN 0 THEN concat('{"severity": ', event_id % 10, ', "message": "db down"}')
 WHEN 1 THEN concat('{"level": ', (event_id % 7) * 10, ', "msg": ', event_id, '}')
 WHEN 2 THEN concat('{"level": "", "severity": "warning", "log": "x ', event_id, '"}')
 WHEN 3 THEN concat('{"lvl": "crit", "message": "", "time": ', 1700000000 + event_id, '}')
 WHEN 4 THEN concat('{"level": true, "event": false, "ts": ', event_id, '.5}')
 WHEN 5 THEN concat('{"levelname": "[Error]", "msg": null, "text": "t', event_id, '", "hostname": "h1"}')
 WHEN 6 THEN concat('  {"loglevel": "verbose", "message": {"a": 1}, "detail": "d", "name": "lg", "pid": ', event_id, '}')
 WHEN 7 THEN concat('{"level": 2.5, "message": 7.25, "@timestamp": "2024-01-02T03:04:05Z", "host": "", "logger": "core"}')
 WHEN 8 THEN concat('{"severity": 3, "level": "info", "error": "timeout after ', event_id, 'ms"}')
 WHEN 9 THEN concat('{"level": "warn", "message": "status 503 from upstream"')
 WHEN 10 THEN concat('{"level": [], "severity": "bogus", "description": "out of memory", "date": ""}')
 ELSE '{}' END
"""


def json_lines(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "events")).selectExpr(
        "event_id AS line_number", "'svc.log' AS source", f"{JSON_SQL} AS raw"
    )
    return parse_logs(lines, as_of=as_of()).select(_JSON_OUT)


_JSON_OUT = [
    "line_number", "source", "format", "level_name", "timestamp", "ts_epoch", "message",
    "fingerprint", "host", "logger", "pid", "duration_ms",
]
_JSON = sql.with_entries(
    f"SELECT {', '.join(_JSON_OUT)} FROM entries",
    lines=f"""log_lines AS (
  SELECT event_id AS line_number, 'svc.log' AS source, {JSON_SQL} AS raw FROM events)""",
)

# -- tags and level words behind an ISO stamp -------------------------------------------------

TAG_SQL = """concat('2024-01-01T00:00:', CAST(event_id % 50 + 10 AS STRING),
 CASE event_id % 4 WHEN 0 THEN 'Z ' WHEN 1 THEN ',250 ' WHEN 2 THEN '.5+02:00 ' ELSE ' : ' END,
 CASE event_id % 18
 WHEN 0 THEN '[ERROR] [api] payment failed'
 WHEN 1 THEN '[api] [ERROR] payment failed'
 WHEN 2 THEN '(worker) <WARN> - queue is long'
 WHEN 3 THEN '[ERROR] [WARN] both are levels'
 WHEN 4 THEN '[api] [worker] two sources'
 WHEN 5 THEN '[] [ERROR] empty tag'
 WHEN 6 THEN 'I am here'
 WHEN 7 THEN 'pool-1 thread-2 WARN: heap is at 91%'
 WHEN 8 THEN 'a b c err last of four'
 WHEN 9 THEN 'a b c - warn'
 WHEN 10 THEN 'a b c d error is the fifth'
 WHEN 11 THEN 'lower error in the middle, NOTICE later'
 WHEN 12 THEN '[critical]: | disk full'
 WHEN 13 THEN 'ERROR'
 WHEN 14 THEN concat('[req-', CAST(event_id AS STRING), '] GET /x 200 ', CAST(event_id % 900 AS STRING), 'ms')
 WHEN 15 THEN '<34> (FATAL) panic: nil map'
 WHEN 16 THEN concat('x  DEBUG  took ', CAST(event_id AS STRING), ' ms')
 ELSE 'nothing special' END)
"""


def _tag_lines(spark, sf_dir):
    return spread(table(spark, sf_dir, "events")).selectExpr(
        "event_id AS line_number", "'app.log' AS source", f"{TAG_SQL} AS raw"
    )


_TAG_OUT = [
    "line_number", "source", "format", "level_name", "timestamp", "ts_epoch", "message",
    "src", "fingerprint", "duration_ms",
]


def tagged_lines(spark, sf_dir):
    return parse_logs(_tag_lines(spark, sf_dir), as_of=as_of()).select(_TAG_OUT)


_TAGGED = sql.with_entries(
    f"SELECT {', '.join(_TAG_OUT)} FROM entries",
    lines=f"""log_lines AS (
  SELECT event_id AS line_number, 'app.log' AS source, {TAG_SQL} AS raw FROM events)""",
)

# -- natural text: whatever a document line is, it must be read as something --------------------


def _read_histogram(lines):
    return (
        parse_logs(lines, columns=["format", "level_name", "is_error"], as_of=as_of())
        .groupBy("format", "level_name")
        .agg(F.count("*").alias("cnt"), F.count_if("is_error").alias("errors"))
    )


def document_lines(spark, sf_dir):
    """Every line of every document, read as a log line."""
    docs = spread(table(spark, sf_dir, "documents"))
    return _read_histogram(docs.select("source", F.explode(F.split("text", "\n")).alias("raw")))


def conversation_lines(spark, sf_dir):
    """Every line of every conversation turn, read as a log line."""
    turns = spread(table(spark, sf_dir, "conversations")).select(
        F.col("role").alias("source"), F.explode(F.split("text", "\n")).alias("raw")
    )
    return _read_histogram(turns)


def _read_check(text, source, table_name):
    return sql.with_entries(
        """SELECT format, level_name, count(*) AS cnt, count(*) FILTER (WHERE is_error) AS errors
FROM entries GROUP BY ALL""",
        lines=f"""log_lines AS (
  SELECT {source} AS source, unnest(string_split({text}, chr(10))) AS raw, 1 AS line_number
  FROM {table_name})""",
    )


# -- single functions ---------------------------------------------------------------------------

STAMP_SQL = {
    "iso_zulu": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", "%Y-%m-%dT%H:%M:%S.%gZ"),
    "iso_comma": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')", "%Y-%m-%d %H:%M:%S,%g"),
    "iso_plain": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "%Y-%m-%dT%H:%M:%S"),
    "minutes": ("date_format(ts, 'yyyy-MM-dd HH:mm')", "%Y-%m-%d %H:%M"),
    "slashes": ("date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "%Y/%m/%d %H:%M:%S"),
    "clf": ("date_format(ts, 'dd/MMM/yyyy:HH:mm:ss +0000')", "%d/%b/%Y:%H:%M:%S +0000"),
    "offset": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss+02:00')", "%Y-%m-%d %H:%M:%S+02:00"),
    "syslog": ("date_format(ts, 'MMM dd HH:mm:ss')", "%b %d %H:%M:%S"),
    "us": ("date_format(ts, 'MM/dd/yyyy HH:mm:ss')", "%m/%d/%Y %H:%M:%S"),
    "date": ("date_format(ts, 'yyyy-MM-dd')", "%Y-%m-%d"),
    "bad": ("concat('2024-13-', date_format(ts, 'dd HH:mm:ss'))", "2024-13-%d %H:%M:%S"),
    "number": ("CAST(unix_timestamp(ts) AS STRING)", None),
}


def timestamp_epochs(spark, sf_dir):
    picks = " ".join(f"WHEN {i} THEN {s}" for i, (s, _) in enumerate(STAMP_SQL.values()))
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(STAMP_SQL))
    stamps = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"CASE event_id % {len(STAMP_SQL)} {names} END AS kind",
        f"CASE event_id % {len(STAMP_SQL)} {picks} END AS stamp",
    )
    return with_epoch(stamps, "stamp", "ts_epoch", as_of())


def _stamps_check():
    picks = " ".join(
        f"WHEN {i} THEN strftime(ts, '{f}')" if f else
        f"WHEN {i} THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)"
        for i, (_, f) in enumerate(STAMP_SQL.values())
    )
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(STAMP_SQL))
    return f"""WITH s AS (SELECT event_id, CASE event_id % {len(STAMP_SQL)} {names} END AS kind,
  CASE event_id % {len(STAMP_SQL)} {picks} END AS stamp FROM events)
SELECT event_id, kind, stamp, {sql.epoch_of('stamp')} AS ts_epoch FROM s"""


TOKEN_SQL = """CASE event_id % 11 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat('[', event_type, ']')
 WHEN 2 THEN '  warn  ' WHEN 3 THEN 'Warning:' WHEN 4 THEN '<crit>' WHEN 5 THEN 'E' WHEN 6 THEN 'emergency'
 WHEN 7 THEN 'nonsense' WHEN 8 THEN '' WHEN 9 THEN '(dbg)' ELSE props END"""


def level_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").selectExpr("event_id", f"{TOKEN_SQL} AS token")
    return tokens.select(
        "event_id", "token", lookup_level("token").alias("found"),
        F.expr(level_name_sql(parse_level_sql("token"))).alias("level_name"),
    )


def text_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lowered", F.lower("text"))
    return docs.select("doc_id", F.expr(error_gate_sql("text", "lowered")).alias("gated"))


def durations(spark, sf_dir):
    return log_lines(spark, sf_dir).select(
        "line_number", F.expr(duration_sql("raw")).alias("duration_ms")
    )


def classified_messages(spark, sf_dir):
    lines = log_lines(spark, sf_dir).select("line_number", "raw")
    return classify(lines, "raw").select("line_number", "min_level", "signature", "duration_ms")


_CLASSIFIED = sql.with_lines(f"""SELECT line_number, signature, duration_ms,
  greatest({sql.level_from_text('raw')}, coalesce({sql.floor_of('signature')}, 0)) AS min_level
FROM (SELECT line_number, raw, {sql.duration('raw')} AS duration_ms,
  coalesce(CASE WHEN {sql.gate('raw')} THEN {sql.signature('raw')} END, '') AS signature
  FROM log_lines)""")


def signature_levels(spark, sf_dir):
    return (
        parsed(spark, sf_dir, "fingerprint", "level_name")
        .groupBy("fingerprint", "level_name").agg(F.count("*").alias("cnt"))
    )


def message_analysis(spark, sf_dir):
    return analyze(parsed(spark, sf_dir)).select(
        "line_number", "level", "level_priority", "is_error", "max_severity",
        F.array_join("error_categories", ",").alias("error_categories"),
    )


_ANALYSIS = sql.with_entries(f"""SELECT line_number, level, level AS level_priority,
  level >= 40 AS is_error, level AS max_severity, fingerprint AS error_categories
FROM (SELECT line_number, fingerprint, greatest(level, {sql.level_from_text('message')},
    coalesce({sql.floor_of('sig2')}, 0)) AS level
  FROM (SELECT *, CASE WHEN {sql.gate('message')} THEN {sql.signature('message')} END AS sig2
        FROM entries))""")


def entry_records(spark, sf_dir):
    return entry_record(parsed(spark, sf_dir)).drop("meta")


# A user's own signature table instead of the built-in one.
CUSTOM_SIGNATURES = (
    Signature("slow_job", "Batch", 47, r"\bjob \d+ completed\b", ("job",)),
    Signature("heartbeat", "Health", 31, r"\broutine heartbeat\b", None),
    Signature("any_status", "HTTP", 41, r"\bstatus \d{3}\b", ("status",)),
)


def custom_signatures(spark, sf_dir):
    return parsed(
        spark, sf_dir, "line_number", "level_name", "fingerprint", signatures=CUSTOM_SIGNATURES
    ).drop("file")


def _shouting(df):
    """A user's own parser: the line as it is, in capitals."""
    return df.select("line_number", F.upper("raw").alias("message"))


def custom_parser(spark, sf_dir):
    return parse_logs(log_lines(spark, sf_dir), parse=_shouting)


QUERIES = {
    "parsed_entries": (parsed_entries, sql.with_entries(f"SELECT {', '.join(_ALL)} FROM entries")),
    "format_histogram": (
        format_histogram,
        sql.with_entries("SELECT format, count(*) AS cnt FROM entries GROUP BY format"),
    ),
    "json_entries": _format_query(
        "json", "level_name", "timestamp", "ts_epoch", "message", "host", "logger", "pid"
    ),
    "iso_entries": _format_query("iso", "level_name", "timestamp", "ts_epoch", "message", "src"),
    "bracket_entries": _format_query("bracket", "level_name", "timestamp", "ts_epoch", "message"),
    "syslog_entries": _format_query(
        "syslog", "level_name", "timestamp", "ts_epoch", "message", "host", "tag", "pid"
    ),
    "access_entries": _format_query(
        "access", "level_name", "timestamp", "ts_epoch", "message", "fingerprint", "ip",
        "status_code", "bytes", "method", "path",
    ),
    "loose_entries": _format_query("loose", "level_name", "timestamp", "message"),
    "entry_meta": (entry_meta, _META),
    "json_value_types": (json_lines, _JSON),
    "tagged_lines": (tagged_lines, _TAGGED),
    "document_lines": (document_lines, _read_check("text", "source", "documents")),
    "conversation_lines": (conversation_lines, _read_check("text", "role", "conversations")),
    "timestamp_epochs": (timestamp_epochs, _stamps_check()),
    "level_tokens": (level_tokens, f"""SELECT event_id, token,
  {sql.lookup_level('token')} AS found,
  {sql.level_name(f"coalesce({sql.lookup_level('token')}, 20)")} AS level_name
FROM (SELECT event_id, {TOKEN_SQL} AS token FROM events)"""),
    "text_gate": (text_gate, f"SELECT doc_id, {sql.gate('text')} AS gated FROM documents"),
    "durations": (
        durations,
        sql.with_lines(f"SELECT line_number, {sql.duration('raw')} AS duration_ms FROM log_lines"),
    ),
    "classified_messages": (classified_messages, _CLASSIFIED),
    "signature_levels": (
        signature_levels,
        sql.with_entries(
            "SELECT fingerprint, level_name, count(*) AS cnt FROM entries GROUP BY ALL"
        ),
    ),
    "message_analysis": (message_analysis, _ANALYSIS),
    "entry_records": (
        entry_records,
        sql.with_entries("""SELECT timestamp, ts_epoch, level_name AS level, source, line_number,
  message, raw, fingerprint FROM entries"""),
    ),
    "custom_signatures": (
        custom_signatures,
        sql.with_entries(
            "SELECT line_number, level_name, fingerprint FROM entries",
            signatures=CUSTOM_SIGNATURES,
        ),
    ),
    "custom_parser": (
        custom_parser, sql.with_lines("SELECT line_number, upper(raw) AS message FROM log_lines")
    ),
}
