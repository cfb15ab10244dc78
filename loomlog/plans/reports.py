"""Queries over filters, statistics, ordered rows and display functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.functions import text
from loomlog.operators import anomaly, rates, stats
from loomlog.operators.filters import add_search_spans, apply_filters, build_spec, parse_filtered
from loomlog.operators.order import context_or_tail, last_rows, with_context
from loomlog.plans import check_base as sql
from loomlog.plans.parsing import parsed, placed_entries
from loomlog.sources.tables import SECOND_SQL, as_of, log_lines, table

_NARROW = ("line_number", "source", "raw", "level", "level_name", "is_error")


def _filtered(condition, **spec):
    def run(spark, sf_dir):
        lines = log_lines(spark, sf_dir)
        entries = parse_filtered(lines, build_spec(**spec), columns=_NARROW, as_of=as_of())
        return entries.select("line_number", "source", "level_name")

    return run, sql.with_entries(
        f"SELECT line_number, source, level_name FROM entries WHERE {condition}"
    )


_DESCRIBED = (  # a filter, its words, and its condition in SQL
    ({}, "no filters (showing everything)", "true"),
    ({"min_level": "ERROR", "include": "redis"}, "level >= ERROR; contains all of [redis]",
     "level >= 40 AND contains(lower(raw), 'redis')"),
    ({"max_level": "INFO", "exclude": "status,job"}, "level <= INFO; excludes [status, job]",
     "level <= 20 AND NOT contains(lower(raw), 'status') AND NOT contains(lower(raw), 'job')"),
    ({"error_only": True, "exclude_regex": "time(d )?out"},
     "errors only; 1 regex exclude(s)",
     "level >= 40 AND NOT regexp_matches(raw, 'time(d )?out', 'i')"),
    ({"search": "disk"}, "highlighting [disk]", "true"),
)


def described_filters(spark, sf_dir):
    """Filters in words with the number of lines that pass each, counted in one pass."""
    entries = parsed(spark, sf_dir, "source", "raw", "level")
    counted = []
    for given, _, _ in _DESCRIBED:
        spec = build_spec(**given)
        passed = spec.condition()
        count = F.count("*") if passed is None else F.count_if(passed)
        counted.append(F.struct(F.lit(spec.describe()).alias("filter"), count.alias("cnt")))
    return entries.agg(F.array(*counted).alias("all")).select(F.inline("all"))


# -- search spans -----------------------------------------------------------------------------


def _spans(df, key, column, terms):
    found = add_search_spans(df.select(key, column), column, terms)
    shown = F.array_join(
        F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ","
    )
    return found.select(key, shown.alias("spans"))


def _spans_check(relation, key, column, terms):
    """Occurrences by splitting; a later term gives way to the spans of the terms before it."""
    steps, kept = [], "CAST([] AS STRUCT(s BIGINT, e BIGINT)[])"
    steps.append(f"s0 AS (SELECT {key}, lower({column}) AS low, {kept} AS spans FROM {relation})")
    for i, term in enumerate(terms, 1):
        size = len(term)
        steps.append(f"""p{i} AS (SELECT *, string_split(low, {sql.q(term)}) AS parts FROM s{i - 1})""")
        steps.append(f"""o{i} AS (SELECT {key}, low, spans, list_transform(
  list_filter(range(1, len(parts)), lambda k: true),
  lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * {size}) AS starts
  FROM p{i})""")
        steps.append(f"""s{i} AS MATERIALIZED (SELECT {key}, low, list_concat(spans, list_transform(
  list_filter(starts, lambda b: len(list_filter(spans, lambda p: p.s < b + {size} AND b < p.e)) = 0),
  lambda b: {{'s': CAST(b AS BIGINT), 'e': CAST(b + {size} AS BIGINT)}})) AS spans FROM o{i})""")
    return ",\n".join(steps), f"""SELECT {key}, array_to_string(list_transform(list_sort(spans),
  lambda p: concat(p.s, '-', p.e)), ',') AS spans FROM s{len(terms)}"""


_TERMS = ("deadlock", "error", "re", "lock wait", "e", "(429)")


def search_spans(spark, sf_dir):
    return _spans(log_lines(spark, sf_dir), "line_number", "raw", _TERMS)


def _search_spans_check():
    steps, select = _spans_check("log_lines", "line_number", "raw", _TERMS)
    return f"WITH {sql.LINES},\n{steps}\n{select}"


_DOC_TERMS = ("license", "password", "the", "http")


def document_spans(spark, sf_dir):
    return _spans(table(spark, sf_dir, "documents"), "doc_id", "text", _DOC_TERMS)


def _document_spans_check():
    steps, select = _spans_check("documents", "doc_id", "text", _DOC_TERMS)
    return f"WITH {steps}\n{select}"


def filtered_documents(spark, sf_dir):
    """The substring filter on whole documents."""
    lowered = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    words = text.contains_all_sql("low", ("the", "and"))
    return lowered.filter(f"{words} AND NOT contains(low, 'license')").select("doc_id", "lang")


# -- statistics ---------------------------------------------------------------------------------

_TALLY = ("level_name", "source", "line_number", "is_error", "fingerprint", "ts_epoch")
# the log lines are numbered through; that number is their place in the input
_PLACE = ("line_number",)


def _tally(spark, sf_dir, *columns):
    return parsed(spark, sf_dir, *(columns or _TALLY))


def totals(spark, sf_dir):
    found = stats.totals(_tally(spark, sf_dir, "is_error"))
    return found.withColumns({
        "error_ratio": F.round("error_ratio", 6), "error_percent": F.round("error_percent", 6),
    })


def signature_shares(spark, sf_dir):
    top = stats.top_signatures(_tally(spark, sf_dir), stats.REPORT_SIGNATURES, _PLACE)
    return stats.share_of_peak(top).withColumn("share", F.round("share", 6))


def duration_percentiles(spark, sf_dir):
    found = stats.exact_percentiles(
        _tally(spark, sf_dir, "duration_ms"), "duration_ms", (0, 50, 90, 99, 99.9, 150)
    )
    return found.withColumn("value", F.round("value", 6))


def epoch_percentiles(spark, sf_dir):
    """Percentiles of values that lie very close to each other for their size."""
    seconds = table(spark, sf_dir, "events").selectExpr(f"{SECOND_SQL} AS sec")
    found = stats.exact_percentiles(seconds, "sec", (1, 25, 50, 75, 99))
    return found.withColumn("value", F.round("value", 3))


def value_percentiles(spark, sf_dir):
    found = stats.exact_percentiles(
        table(spark, sf_dir, "events"), "value", (1, 25, 50, 75, 95), by=["event_type"]
    )
    return found.withColumn("value", F.round("value", 6))


def sketched_percentiles(spark, sf_dir):
    """Percentiles of prices by clerk group from sketches per day, and whether their ranks are near."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS priority", "o_orderdate AS day", "CAST(o_totalprice AS DOUBLE) AS price"
    )
    days = stats.quantile_sketches(orders, "price", ["priority", "day"])
    whole = stats.merge_sketches(days, ["priority"])
    found = stats.sketch_percentiles(whole, (1, 25, 50, 90, 99), ["priority"])
    # a priority has five rows of percentiles: the ranks of its values are counted once
    ranks = orders.join(found, "priority").groupBy("priority", "percent").agg(
        F.count_if(F.col("price") < F.col("value")).alias("below"),
        F.count_if(F.col("price") <= F.col("value")).alias("upto"), F.count("*").alias("n"),
    )
    rank, slack = F.col("percent") / 100 * F.col("n"), F.col("n") * 0.015 + 1
    near = (F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)
    return ranks.select("priority", "percent", "n", near.alias("near"))


def statistics_snapshot(spark, sf_dir):
    def flat(column):
        pairs = F.array_sort(F.map_entries(column))
        shown = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(shown, ",").alias(column)

    top = F.transform("top_signatures", lambda p: F.concat(p["name"], F.lit("="), p["cnt"]))
    found = stats.snapshot(_tally(spark, sf_dir), order=_PLACE)
    return found.select(
        "total_lines", "total_errors", F.round("lines_per_sec", 6).alias("lines_per_sec"),
        "peak_lines_per_sec", "errors_last_minute", "errors_last_5m",
        F.round("error_rate_per_min", 6).alias("error_rate_per_min"), "unique_errors",
        flat("level_counts"), flat("source_counts"), flat("error_counts"),
        flat("category_counts"), F.array_join(top, ",").alias("top_signatures"),
        F.round("baseline_rate", 6).alias("baseline_rate"), "spike_active",
        F.round("spike_ratio", 6).alias("spike_ratio"), "sparkline", "dropped_lines",
    )


def _named(relation, name, test, limit):
    return f"""(SELECT string_agg(concat(name, '=', cnt), ',' ORDER BY name) FROM (
  SELECT {name} AS name, count(*) AS cnt FROM entries WHERE {test} GROUP BY 1
  ORDER BY cnt DESC, min(line_number) LIMIT {limit}))"""


_KEEP = repr(anomaly.KEEP)
_SNAPSHOT = f"""WITH {sql.LINES},{sql.entries()},
timed AS (SELECT *, CASE WHEN ts_epoch > 0 THEN CAST(floor(ts_epoch) AS BIGINT) END AS sec,
  (SELECT CAST(max(floor(ts_epoch)) AS BIGINT) FROM entries WHERE ts_epoch > 0) AS now FROM entries),
seconds AS (SELECT sec, count(*) AS n, count(*) FILTER (WHERE is_error) AS err FROM timed
  WHERE sec IS NOT NULL GROUP BY sec),
counts AS (SELECT count(*) AS total_lines, count(*) FILTER (WHERE is_error) AS total_errors,
    max(now) AS now, min(sec) AS first, count(*) FILTER (WHERE sec > now - 60) AS l60,
    min(sec) FILTER (WHERE sec > now - 60) AS old60,
    min(sec) FILTER (WHERE sec > now - 60 AND is_error) AS olde60,
    count(*) FILTER (WHERE sec > now - 60 AND is_error) AS errors_last_minute,
    count(*) FILTER (WHERE sec > now - 300 AND is_error) AS errors_last_5m,
    (SELECT max(n) FROM seconds WHERE sec > (SELECT max(sec) - 60 FROM seconds)) AS peak_lines_per_sec,
    {_named('entries', 'level_name', 'true', 300)} AS level_counts,
    {_named('entries', 'source', "source <> ''", 10)} AS source_counts,
    {_named('entries', 'level_name', 'is_error', 300)} AS error_counts,
    {_named('entries', 'fingerprint', "is_error AND fingerprint <> ''", 10)} AS category_counts,
    (SELECT string_agg(concat(name, '=', cnt), ',' ORDER BY cnt DESC, seen) FROM (
       SELECT fingerprint AS name, count(*) AS cnt, min(line_number) AS seen FROM entries
       WHERE is_error AND fingerprint <> '' GROUP BY 1 ORDER BY cnt DESC, seen LIMIT 12)) AS top_signatures,
    (SELECT count(DISTINCT fingerprint) FROM entries
       WHERE is_error AND fingerprint <> '') AS unique_errors
  FROM timed),
rated AS (SELECT *,
  coalesce(errors_last_minute / greatest(1, least(now - olde60 + 1, 60)) * 60, 0) AS rate,
  now - first > 4 AND (now - first) % 5 = 0 AS at_tick,
  (now - first) // 5 - CASE WHEN now - first > 4 AND (now - first) % 5 = 0 THEN 1 ELSE 0 END AS done
  FROM counts),
ticks AS (SELECT k, done, first + 5 * k AS tick FROM (
  SELECT unnest(range(greatest(1, done - 400), done + 1)) AS k, done, first FROM rated)),
pushes AS (SELECT t.k, pow({_KEEP}, any_value(done) - t.k) * (1 - {_KEEP}) * (greatest(1,
    sum(s.err) / greatest(1, least(t.tick - min(s.sec) + 1, 60)) * 60) - 1) AS push
  FROM ticks t JOIN seconds s ON s.err > 0 AND s.sec > t.tick - 60 AND s.sec <= t.tick
  GROUP BY t.k, t.tick),
judged AS (SELECT *, 1 - 0.5 * pow({_KEEP}, done)
  + coalesce((SELECT sum(push) FROM pushes), 0) AS base FROM rated),
series AS (SELECT g.sec, coalesce(s.n, 0) AS n, max(coalesce(s.n, 0)) OVER () AS hi,
    min(coalesce(s.n, 0)) OVER () AS lo
  FROM (SELECT unnest(range(now - 59, now + 1)) AS sec FROM counts) g LEFT JOIN seconds s USING (sec))
SELECT total_lines, total_errors, peak_lines_per_sec, errors_last_minute, errors_last_5m,
  level_counts, source_counts, error_counts, category_counts, top_signatures, unique_errors,
  round(l60 / greatest(1, least(now - old60 + 1, 60)), 6) AS lines_per_sec,
  round(rate, 6) AS error_rate_per_min, round(rate / base, 6) AS spike_ratio,
  rate >= 5 AND total_errors >= 10 AND rate / base >= 3 AS spike_active,
  round(CASE WHEN at_tick THEN {_KEEP} * base + (1 - {_KEEP}) * greatest(rate, 1) ELSE base END, 6)
    AS baseline_rate,
  (SELECT string_agg(CASE WHEN hi = lo THEN CASE WHEN hi <= 0 THEN ' ' ELSE '▃' END ELSE
     substr({sql.q(rates.SPARK_CHARS)}, CAST(floor((n - lo) / (hi - lo) * 8) AS INT) + 1, 1) END,
     '' ORDER BY sec) FROM series) AS sparkline,
  CAST(0 AS BIGINT) AS dropped_lines
FROM judged"""


def _top_check(name, test, limit):
    return sql.with_entries(f"""SELECT {name}, cnt FROM (
  SELECT {name}, count(*) AS cnt, min(line_number) AS seen FROM entries WHERE {test} GROUP BY 1)
ORDER BY cnt DESC, seen LIMIT {limit}""")


def source_freshness(spark, sf_dir):
    entries = _tally(spark, sf_dir, "source", "line_number", "ts_epoch")
    return stats.source_freshness(entries, as_of(), 172_800.0)


# -- rows in order --------------------------------------------------------------------------------

TAIL = 40
# beyond one ordered limit, below the lines of the tables
BUFFER_ROWS = 9_950


def tail_per_source(spark, sf_dir):
    return last_rows(log_lines(spark, sf_dir), TAIL, groups=["source"], width=512)


def recent_rows(spark, sf_dir):
    return stats.recent_rows(log_lines(spark, sf_dir), 3_000, _PLACE)


def recent_buffer(spark, sf_dir):
    """A large buffer; all but a few lines."""
    return last_rows(log_lines(spark, sf_dir), BUFFER_ROWS, groups=[], width=512).select(
        "line_number", "source"
    )


def last_errors(spark, sf_dir):
    entries = parsed(spark, sf_dir, "line_number", "raw", "timestamp", "level_name", "is_error")
    return stats.last_errors(entries, order=_PLACE).select(
        F.coalesce(text.empty_to_null(F.col("timestamp")), F.lit("-")).alias("timestamp"),
        "level_name", "raw", "line_number",
    )


def latest_error(spark, sf_dir):
    entries = parsed(spark, sf_dir, "line_number", "raw", "is_error", "fingerprint")
    return stats.latest_error(entries, order=_PLACE).select("line_number", "raw", "fingerprint")


def context_windows(spark, sf_dir):
    """The lines around every error line, source by source."""
    entries = placed_entries(spark, sf_dir, "line_number", "raw", "is_error")
    found = with_context(entries, F.col("is_error"), half=6, width=256, position="position")
    return found.select(
        "line_number", "source",
        F.size("context").cast("bigint").alias("lines"),
        F.md5(F.array_join("context", "\n")).alias("context_md5"),
        F.md5(F.array_join(F.slice("context", 1, 12), "\n")).alias("related_md5"),
    )


_CONTEXT = sql.with_entries("""SELECT line_number, source, len(context) AS lines,
  md5(array_to_string(context, chr(10))) AS context_md5,
  md5(array_to_string(context[1:12], chr(10))) AS related_md5
FROM (SELECT line_number, file AS source, is_error, list(raw) OVER (
    PARTITION BY file ORDER BY line_number ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context
  FROM entries) WHERE is_error""")



def context_fallback(spark, sf_dir):
    """The lines around the crashes of each log, or the last twelve of a log without one."""
    entries = placed_entries(spark, sf_dir, "line_number", "raw", "fingerprint")
    crash = F.col("raw").contains("segmentation fault") & (F.col("line_number") % 4 == 1)
    crash &= F.col("source") < "svc3"
    found = context_or_tail(entries, crash, half=6, position="position")
    return found.select(
        "line_number", "source", F.size("context").cast("bigint").alias("lines"),
        F.md5(F.array_join("context", "\n")).alias("context_md5"),
    )


_FALLBACK = sql.with_entries("""SELECT line_number, source, len(context) AS lines,
  md5(array_to_string(context, chr(10))) AS context_md5
FROM (SELECT line_number, source, CASE WHEN any_hit THEN around ELSE tail END AS context, hit, any_hit, k
  FROM (SELECT *, bool_or(hit) OVER (PARTITION BY source) AS any_hit,
      row_number() OVER (PARTITION BY source ORDER BY line_number DESC) AS k,
      list(raw) OVER (PARTITION BY source ORDER BY line_number
        ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS around,
      list(raw) OVER (PARTITION BY source ORDER BY line_number
        ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS tail
    FROM (SELECT line_number, file AS source, raw, contains(raw, 'segmentation fault')
      AND line_number % 4 = 1 AND file < 'svc3' AS hit FROM entries)))
WHERE hit OR (NOT any_hit AND k = 1)""")

# -- display functions ---------------------------------------------------------------------------


def shown_orders(spark, sf_dir):
    """Epochs, sizes and durations as text."""
    price = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.format_timestamp(price * 7000).alias("stamp"),
        text.human_readable_size(F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("size"),
        text.format_duration(price - 1000).alias("duration"),
        text.format_duration(F.col("o_orderkey") / 64).alias("short_duration"),
    )


def _size_check(x):
    units = text.SIZE_UNITS
    cases = " ".join(
        f"WHEN {x} < {1024.0 ** (i + 1)!r} THEN format('{{:.2f}} {u}', {x} / {1024.0 ** i!r})"
        for i, u in enumerate(units) if i
    )
    return f"""CASE WHEN {x} <= 0 THEN '0 B'
  WHEN {x} < 1024.0 THEN concat(CAST(floor({x}) AS BIGINT), ' B') {cases} END"""


def _duration_check(x):
    return f"""CASE WHEN {x} IS NULL OR {x} < 0 THEN '-'
  WHEN {x} < 1 THEN concat(CAST(round_even({x} * 1000, 0) AS BIGINT), 'ms')
  WHEN {x} < 60 THEN format('{{:.2f}}s', {x})
  WHEN {x} < 3600 THEN concat(CAST(floor({x}) AS BIGINT) // 60, 'm ', CAST(floor({x}) AS BIGINT) % 60, 's')
  WHEN {x} < 86400 THEN concat(CAST(floor({x}) AS BIGINT) // 3600, 'h ', CAST(floor({x}) AS BIGINT) // 60 % 60, 'm')
  ELSE concat(CAST(floor({x}) AS BIGINT) // 86400, 'd ', CAST(floor({x}) AS BIGINT) // 3600 % 24, 'h') END"""


_SHOWN_ORDERS = f"""SELECT o_orderkey,
  coalesce(CASE WHEN p * 7000 > 0 THEN strftime(make_timestamp(CAST(floor(p * 7000 * 1000000) AS BIGINT)),
    '%Y-%m-%d %H:%M:%S') END, '-') AS stamp,
  {_size_check('sz')} AS size, {_duration_check('(p - 1000)')} AS duration,
  {_duration_check('d')} AS short_duration
FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, o_orderkey / 64.0 AS d,
  CAST(o_orderkey * o_orderkey * 1000 AS DOUBLE) AS sz FROM orders)"""


def shown_pages(spark, sf_dir):
    """Cut, escaped and base-name texts of whole pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.truncate_string(F.col("html"), 50).alias("short"),
        text.truncate_string(F.col("url"), 2).alias("tiny"),
        F.md5(text.escape_html(F.col("html"))).alias("escaped_md5"),
        text.base_name(F.col("url")).alias("base"),
        F.md5(text.markdown_cell(F.col("html"))).alias("cell_md5"),
    )


_SHOWN_PAGES = """SELECT page_id,
  CASE WHEN length(html) <= 50 THEN html ELSE concat(html[1:47], '...') END AS short,
  url[1:2] AS tiny,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '"', '&quot;'), '''', '&#x27;')) AS escaped_md5,
  list_last(string_split(url, '/')) AS base,
  md5(replace(replace(replace(replace(html, '\\', '\\\\'), '|', '\\|'), chr(13), ' '), chr(10), ' ')) AS cell_md5
FROM pages"""


QUERIES = {
    "filter_min_level": _filtered("level >= 30", min_level="warning"),
    "filter_level_range": _filtered("level BETWEEN 20 AND 40", min_level="INFO", max_level=40),
    "filter_errors_only": _filtered("is_error", error_only=True),
    "filter_sources": _filtered(
        "source IN ('svc1.log', 'web-03')", sources=["svc1.log", "web-03"]
    ),
    "filter_include": _filtered(
        "contains(lower(raw), 'redis') AND contains(lower(raw), 'error')", include="Redis, ERROR"
    ),
    "filter_exclude": _filtered(
        "NOT contains(lower(raw), 'heartbeat') AND NOT contains(lower(raw), 'job')",
        exclude="heartbeat,job",
    ),
    "filter_exclude_regex": _filtered(
        r"NOT regexp_matches(raw, 'status (4|5)\d\d', 'i') AND NOT regexp_matches(raw, '^10\.', 'i')",
        exclude_regex=[r"status (?P<class>4|5)\d\d", r"^10\."],
    ),
    "filter_regex_dialect": _filtered(
        r"NOT regexp_matches(raw, 'job 12|[\[a]b|o{2,3}ls|[a&b]x|zq{0,3}z$', 'i')",
        exclude_regex=[r"(?P<my_id>job) 12", r"[[a]b", r"o{2,3}ls", r"[a&&b]x", r"zq{,3}z\Z"],
    ),
    "filter_combined": _filtered(
        """level >= 40 AND source IN ('svc2.log', 'svc4.log') AND contains(lower(raw), 'ms')
        AND NOT contains(lower(raw), 'zzz') AND NOT regexp_matches(raw, 'curl', 'i')""",
        min_level="error", error_only=True, sources=["svc2.log", "svc4.log"], include=" MS ,,",
        exclude="zzz", exclude_regex="curl",
    ),
    "filter_nothing": _filtered("true", min_level="loud", search="deadlock"),
    "filtered_documents": (filtered_documents, """SELECT doc_id, lang FROM documents
WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')
  AND NOT contains(lower(text), 'license')"""),
    "described_filters": (described_filters, sql.with_entries(" UNION ALL ".join(
        f"SELECT {sql.q(words)} AS filter, count(*) AS cnt FROM entries WHERE {condition}"
        for _, words, condition in _DESCRIBED))),
    "search_spans": (search_spans, _search_spans_check()),
    "document_spans": (document_spans, _document_spans_check()),
    "totals": (totals, sql.with_entries("""SELECT count(*) AS total_lines,
  count(*) FILTER (WHERE is_error) AS total_errors,
  round(count(*) FILTER (WHERE is_error) / count(*), 6) AS error_ratio,
  round(count(*) FILTER (WHERE is_error) / count(*) * 100, 6) AS error_percent FROM entries""")),
    "level_counts": (
        lambda spark, d: stats.level_counts(_tally(spark, d, "level_name")),
        sql.with_entries("SELECT level_name, count(*) AS cnt FROM entries GROUP BY level_name"),
    ),
    "source_counts": (
        lambda spark, d: stats.source_counts(
            _tally(spark, d, "source", "line_number"), order=_PLACE),
        _top_check("source", "source <> ''", 10),
    ),
    "error_level_counts": (
        lambda spark, d: stats.error_level_counts(_tally(spark, d, "level_name", "is_error")),
        sql.with_entries(
            "SELECT level_name, count(*) AS cnt FROM entries WHERE is_error GROUP BY level_name"
        ),
    ),
    "error_signature_counts": (
        lambda spark, d: stats.top_signatures(
            _tally(spark, d), stats.TOP_CATEGORIES, _PLACE),
        _top_check("fingerprint", "is_error AND fingerprint <> ''", 10),
    ),
    "top_signatures": (
        lambda spark, d: stats.top_signatures(_tally(spark, d), order=_PLACE),
        _top_check("fingerprint", "is_error AND fingerprint <> ''", 12),
    ),
    "signature_shares": (signature_shares, sql.with_entries(
        """SELECT fingerprint, cnt, round(cnt / max(cnt) OVER (), 6) AS share,
  greatest(1, CAST(round_even(cnt / max(cnt) OVER () * 40, 0) AS INT)) AS cells FROM (
  SELECT fingerprint, count(*) AS cnt, min(line_number) AS seen FROM entries
  WHERE is_error AND fingerprint <> '' GROUP BY 1 ORDER BY cnt DESC, seen LIMIT 10)""")),
    "seen_window": (
        lambda spark, d: stats.seen_window(
            _tally(spark, d, "timestamp", "ts_epoch", "line_number"), _PLACE),
        sql.with_entries("""SELECT
  (SELECT timestamp FROM entries WHERE ts_epoch > 0 ORDER BY ts_epoch, line_number LIMIT 1) AS first_seen,
  (SELECT timestamp FROM entries WHERE ts_epoch > 0 ORDER BY ts_epoch DESC, line_number LIMIT 1) AS last_seen"""),
    ),
    "distinct_counts": (
        lambda spark, d: stats.distinct_counts(
            _tally(spark, d, "source", "is_error", "fingerprint")),
        sql.with_entries("""SELECT count(DISTINCT source) AS sources,
  count(DISTINCT fingerprint) FILTER (WHERE is_error AND fingerprint <> '') AS signatures
FROM entries"""),
    ),
    "duration_percentiles": (duration_percentiles, sql.with_entries(
        """SELECT p AS percent, round(quantile_cont(duration_ms, p / 100), 6) AS value
FROM entries, (VALUES (0.0::DOUBLE), (50.0), (90.0), (99.0), (99.9), (100.0)) v(p)
WHERE duration_ms IS NOT NULL GROUP BY p""").replace(
            "quantile_cont(duration_ms, p / 100)",
            "CASE p WHEN 0 THEN quantile_cont(duration_ms, 0.0) WHEN 50 THEN quantile_cont(duration_ms, 0.5) "
            "WHEN 90 THEN quantile_cont(duration_ms, 0.9) WHEN 99 THEN quantile_cont(duration_ms, 0.99) "
            "WHEN 99.9 THEN quantile_cont(duration_ms, 0.999) ELSE quantile_cont(duration_ms, 1.0) END")),
    "epoch_percentiles": (epoch_percentiles, " UNION ALL ".join(
        f"""SELECT {float(p)}::DOUBLE AS percent,
  round(quantile_cont(CAST({SECOND_SQL} AS DOUBLE), {p / 100}), 3) AS value FROM events"""
        for p in (1, 25, 50, 75, 99))),
    "value_percentiles": (value_percentiles, " UNION ALL ".join(
        f"""SELECT event_type, {float(p)}::DOUBLE AS percent,
  round(quantile_cont(value, {p / 100}), 6) AS value FROM events GROUP BY event_type"""
        for p in (1, 25, 50, 75, 95))),
    "sketched_percentiles": (sketched_percentiles,
        """SELECT o_orderpriority AS priority, percent, count(*) AS n, true AS near
FROM orders, (SELECT unnest([1.0, 25.0, 50.0, 90.0, 99.0])::DOUBLE AS percent) GROUP BY ALL"""),
    "statistics_snapshot": (statistics_snapshot, _SNAPSHOT),
    "source_freshness": (source_freshness, sql.with_entries(
        f"""SELECT source, max(line_number) AS last_line,
  max(CASE WHEN ts_epoch > 0 THEN ts_epoch END) AS last_epoch,
  coalesce(epoch(TIMESTAMP '{sql.AS_OF}') - max(CASE WHEN ts_epoch > 0 THEN ts_epoch END) > 172800, true) AS is_stale
FROM entries GROUP BY source""")),
    "tail_per_source": (tail_per_source, sql.with_lines(
        f"""SELECT line_number, source, raw FROM log_lines
QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_number DESC) <= {TAIL}""")),
    "recent_rows": (recent_rows, sql.with_lines(
        "SELECT line_number, source, raw FROM log_lines ORDER BY line_number DESC LIMIT 3000")),
    "recent_buffer": (recent_buffer, sql.with_lines(
        "SELECT line_number, source FROM log_lines ORDER BY line_number DESC LIMIT 9950")),
    "last_errors": (last_errors, sql.with_entries(
        """SELECT coalesce(nullif(timestamp, ''), '-') AS timestamp, level_name,
  raw, line_number FROM entries WHERE is_error
ORDER BY line_number DESC LIMIT 8""")),
    "latest_error": (latest_error, sql.with_entries(
        """SELECT line_number, raw, fingerprint FROM entries WHERE is_error
ORDER BY line_number DESC LIMIT 1""")),
    "context_windows": (context_windows, _CONTEXT),
    "context_fallback": (context_fallback, _FALLBACK),
    "shown_orders": (shown_orders, _SHOWN_ORDERS),
    "shown_pages": (shown_pages, _SHOWN_PAGES),
}
