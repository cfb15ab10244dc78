"""Queries run as streams over the given tables, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators.filters import apply_filters, build_spec
from loomlog.operators.parse import parse_logs
from loomlog.plans import check_base as sql
from loomlog.plans.clock import _KEYED, _tick_columns, _ticks_check
from loomlog.plans.files import landed_lines
from loomlog.session import shared_folder
from loomlog.sources.tables import (
    ERROR_SQL, SECOND_SQL, as_of, lines_from_events, log_lines, table,
)
from loomlog.sources.textlogs import find_logs
from loomlog.streaming import live, tables

DELAY = 5


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _entries(spark, sf_dir, *columns):
    return parse_logs(
        lines_from_events(_events(spark, sf_dir)), columns=columns, as_of=as_of()
    )


def _finished(spark, df):
    """Run a stream to its end into a table and read that."""
    folder = shared_folder(spark)
    live.start_table(df, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


def _running(name):
    def run(spark, sf_dir):
        folder = shared_folder(spark)
        tables.start_totals(
            _entries(spark, sf_dir, name), [name], f"{folder}/totals", f"{folder}/checkpoint"
        ).awaitTermination()
        return tables.Versions(f"{folder}/totals").newest(spark)

    return run, sql.with_entries(f"SELECT {name}, count(*) AS cnt FROM entries GROUP BY {name}")


# batches that landed segments are read in, at most
BATCHES = 12


def live_files(spark, sf_dir):
    """Landed text segments, parsed into a table as they are found."""
    folder = landed_lines(spark, sf_dir)
    # a batch costs about as much for two small files as for a hundred
    segments = find_logs(spark, [folder]).count()
    lines = live.read_live(spark, folder, files_per_trigger=max(2, -(-segments // BATCHES)))
    entries = parse_logs(lines, columns=["format", "fingerprint", "raw"], as_of=as_of())
    done = _finished(spark, entries)
    return done.groupBy("format", "fingerprint").agg(F.count("*").alias("cnt"))


PARTS = 4


def _landings(spark, sf_dir, folder):
    """Land the log lines in four parts, each in order and one after the other; the parts belong
    to two logs in turn. Yields after every part."""
    lines = log_lines(spark, sf_dir)
    last = lines.agg(F.max("line_number")).first()[0]
    ordered = lines.select(
        "line_number", F.expr(f"line_number * {PARTS} div ({last} + 1)").alias("part"),
        F.col("raw").alias("value"),
    )
    for part in range(PARTS):
        (
            ordered.filter(F.col("part") == part).repartitionByRange("line_number")
            .sortWithinPartitions("line_number").select("value")
            .write.text(f"{folder}/log{part % 2}/part{part}")
        )
        yield part


_PARTS = rf"""parts AS (SELECT line_number, raw,
  line_number * {PARTS} // ((SELECT max(line_number) FROM log_lines) + 1) AS part FROM log_lines
  WHERE regexp_matches(raw, '\S'))"""


def live_line_numbers(spark, sf_dir):
    """Four batches of two logs, the query started anew for each."""
    folder = shared_folder(spark)
    log = F.regexp_extract("source", r"/(log\d)/", 1)
    for _ in _landings(spark, sf_dir, f"{folder}/in"):
        # a part is written as several files at once: they follow each other by name
        lines = live.read_live(spark, f"{folder}/in", log=log)
        tables.start_numbered(
            lines, f"{folder}/lines", f"{folder}/c", order=("source", "block")
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/lines").select("log", "line_number", "raw")


def live_since(spark, sf_dir):
    """Only what was landed from the time of the second part on."""
    folder = shared_folder(spark)
    for _ in _landings(spark, sf_dir, f"{folder}/in"):
        pass
    second = spark.read.format("binaryFile").load(f"{folder}/in/log1/part1").select("modificationTime")
    since = second.agg(F.min("modificationTime").cast("string")).first()[0]
    lines = live.read_live(spark, f"{folder}/in", start_at=since)
    part = F.regexp_extract("source", r"/part(\d)/", 1).cast("bigint")
    return _finished(spark, lines.select(part.alias("part"), "raw"))


def live_losses(spark, sf_dir):
    """The dense clock in three batches; a tenth of the lines comes one batch late."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events").selectExpr(
        f"{SECOND_SQL} AS sec", f"{ERROR_SQL} AS is_error", "user_id % 7 AS grp", "event_id"
    )
    ends = events.agg(F.expr("(min(sec) + max(sec)) div 2")).first()[0]
    batches = events.withColumn("batch", F.expr(f"int(sec >= {ends}) + int(event_id % 10 = 0)"))
    for batch in range(3):
        batches.filter(F.col("batch") == batch).selectExpr(
            "timestamp_seconds(sec) AS event_time", "is_error", "grp"
        ).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("event_time timestamp, is_error boolean, grp bigint")
        tables.start_seconds(
            stream.parquet(f"{folder}/in"), f"{folder}/seconds", f"{folder}/c", DELAY, ["grp"]
        ).awaitTermination()
    closed = tables.closed_seconds(spark, f"{folder}/seconds").groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum("err").alias("err"), F.count("*").alias("seconds")
    )
    lost = tables.lost_lines(spark, f"{folder}/seconds")
    every = tables.lost_total(spark, f"{folder}/seconds").alias("all_lost")
    return closed.join(lost, "grp", "left").select("grp", "n", "err", "seconds", "lost", every)


_LOSSES = f"""WITH timed AS (SELECT {SECOND_SQL} AS sec, {ERROR_SQL} AS is_error, user_id % 7 AS grp,
  event_id FROM events),
dealt AS (SELECT *, CAST(sec >= (SELECT (min(sec) + max(sec)) // 2 FROM timed) AS INT)
  + CAST(event_id % 10 = 0 AS INT) AS batch FROM timed),
marks AS (SELECT b.batch, max(d.sec) - {DELAY} AS mark FROM (SELECT DISTINCT batch FROM dealt) b
  JOIN dealt d ON d.batch <= b.batch GROUP BY b.batch),
judged AS (SELECT d.*, coalesce(sec + 1 <= m.mark, false) AS late FROM dealt d
  LEFT JOIN marks m ON m.batch = d.batch - 1)
SELECT grp, CAST(count(*) FILTER (WHERE NOT late AND shut) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE NOT late AND shut AND is_error) AS BIGINT) AS err,
  count(DISTINCT sec) FILTER (WHERE NOT late AND shut) AS seconds,
  nullif(CAST(count(*) FILTER (WHERE late) AS BIGINT), 0) AS lost,
  (SELECT CAST(count(*) AS BIGINT) FROM judged WHERE late) AS all_lost
FROM (SELECT *, sec + 1 <= (SELECT max(mark) FROM marks) AS shut FROM judged) GROUP BY grp"""


def _seconds(spark, sf_dir, keys=()):
    """Closed seconds of the dense clock."""
    dense = _events(spark, sf_dir).selectExpr(
        f"timestamp_seconds({SECOND_SQL}) AS event_time", f"{ERROR_SQL} AS is_error",
        "user_id % 7 AS grp",
    )
    return live.second_counts(dense, f"{DELAY} seconds", keys)


def live_seconds(spark, sf_dir):
    return _finished(spark, live.flat_seconds(_seconds(spark, sf_dir)))


def live_minutes(spark, sf_dir):
    slid = live.sliding_counts(_seconds(spark, sf_dir), 60)
    ended = slid.select(F.unix_timestamp(F.col("window.end")).alias("until"), "n", "err")
    return _finished(spark, ended)


# A second is closed once the watermark, the newest event minus the delay, has reached its end.
_CLOSED = f"sec + 1 <= (SELECT max({SECOND_SQL}) FROM events) - {DELAY}"


def live_spike_ticks(spark, sf_dir):
    """Two streams: lines to closed seconds, and closed seconds to ticks."""
    folder = shared_folder(spark)
    seconds = live.flat_seconds(_seconds(spark, sf_dir, ["grp"]), ["grp"])
    live.start_table(seconds, f"{folder}/seconds", f"{folder}/c1").awaitTermination()
    schema = spark.read.parquet(f"{folder}/seconds").schema
    closed = spark.readStream.schema(schema).parquet(f"{folder}/seconds")
    return _tick_columns(_finished(spark, live.live_spikes(closed, "grp")), "grp")


def live_filtered(spark, sf_dir):
    entries = _entries(spark, sf_dir, "line_number", "source", "raw", "level", "level_name")
    spec = build_spec(min_level="ERROR", include="status")
    return _finished(spark, apply_filters(entries, spec).select("line_number", "level_name"))


def live_diagnoses(spark, sf_dir):
    """Errors diagnosed as they arrive, with the lines around them."""
    folder = shared_folder(spark)
    query = live.start_diagnosis(
        lines_from_events(_events(spark, sf_dir)), f"{folder}/entries", f"{folder}/diagnoses",
        f"{folder}/checkpoint", as_of=as_of(),
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/diagnoses").select(
        "line_number", "rule_id", "summary", "confidence",
        F.md5(F.array_join("related_entries", "\n")).alias("related_md5"),
    )


QUERIES = {
    "live_level_counts": _running("level_name"),
    "live_source_counts": _running("source"),
    "live_signature_counts": _running("fingerprint"),
    "live_files": (live_files, sql.with_entries(
        "SELECT format, fingerprint, count(*) AS cnt FROM entries GROUP BY ALL")),
    "live_line_numbers": (live_line_numbers, sql.with_lines("").rstrip() + f""",
{_PARTS}
SELECT concat('log', part % 2) AS log, raw,
  row_number() OVER (PARTITION BY part % 2 ORDER BY line_number) AS line_number FROM parts"""),
    "live_since": (live_since, sql.with_lines("").rstrip() + f""",
{_PARTS}
SELECT CAST(part AS BIGINT) AS part, raw FROM parts WHERE part >= 1"""),
    "live_losses": (live_losses, _LOSSES),
    "live_seconds": (live_seconds, sql.with_seconds(
        f"SELECT sec, n, err FROM seconds WHERE {_CLOSED}")),
    "live_minutes": (live_minutes, sql.with_seconds(
        f"""SELECT until, CAST(sum(n) AS BIGINT) AS n, CAST(sum(err) AS BIGINT) AS err
FROM (SELECT n, err, unnest(range(sec + 1, sec + 61)) AS until FROM seconds)
WHERE until <= (SELECT max({SECOND_SQL}) FROM events) - {DELAY} GROUP BY until""")),
    "live_spike_ticks": (live_spike_ticks, _ticks_check("grp", f"""open_seconds AS (
  SELECT {_KEYED.split('SELECT ', 1)[1][:-1]}),
seconds AS (SELECT * FROM open_seconds WHERE {_CLOSED})""")),
    "live_filtered": (live_filtered, sql.with_entries(
        """SELECT line_number, level_name FROM entries
WHERE level >= 40 AND contains(lower(raw), 'status')""")),
    "live_diagnoses": (live_diagnoses, f"""WITH {sql.LINES},{sql.entries()},
near AS MATERIALIZED (SELECT *, list(raw) OVER (PARTITION BY file ORDER BY line_number
  ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context FROM entries),
hit AS MATERIALIZED (SELECT *, {sql.rule_hits('raw')} AS hits FROM near WHERE is_error)
SELECT line_number, hits[1].rule_id AS rule_id,
  CASE WHEN len(hits) = 0 THEN left(array_to_string(string_split(trim(raw), ' ')[1:6], ' '), 80)
    ELSE {sql.rule_field('hits[1].rule_id', 'title')} END AS summary,
  coalesce({sql.rule_field('hits[1].rule_id', 'confidence')}, 'low') AS confidence,
  md5(array_to_string(context[1:12], chr(10))) AS related_md5 FROM hit"""),
}
