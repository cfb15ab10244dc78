"""Log lines derived from the ``events`` table.

There is no log table among the given ones, so lines in seven formats are projected from the
events. The expressions are plain SQL text, so that the same text serves the check queries;
only the four timestamp renderings differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The moment the fixture was "read": decides the year of syslog stamps.
AS_OF = "2024-01-31 00:00:00"

LEVEL_SQL = """
CASE event_type WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 'CRITICAL' ELSE 'ERROR' END
 WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'NOTICE' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END
"""

MESSAGE_SQL = """
CASE event_id % 30
 WHEN 0 THEN concat('POST /cart/', n, '/items took ', n, 'ms')
 WHEN 1 THEN concat('ledger shard ', svc, ': deadlock detected, victim session ', n)
 WHEN 2 THEN concat('worker ', n, ' stopped: Out of memory, cgroup limit reached')
 WHEN 3 THEN concat('cannot reach billing-', svc, ': connection refused')
 WHEN 4 THEN concat('slow query on table invoices, ', n, 'ms')
 WHEN 5 THEN concat('spool ', svc, ': write failed, No space left on device')
 WHEN 6 THEN concat('edge ', svc, ' saw status 502 for /basket')
 WHEN 7 THEN concat('edge ', svc, ' saw status 404 for /icons/', n)
 WHEN 8 THEN 'ValueError: price must not be negative'
 WHEN 9 THEN concat('child ', n, ' ended by segmentation fault')
 WHEN 10 THEN concat('insert rejected: unique constraint on customer ', n)
 WHEN 11 THEN concat('fetch of feed ', n, ' timed out')
 WHEN 12 THEN concat('Permission denied while opening /srv/vault/', n)
 WHEN 13 THEN concat('authentication failed for account ', n)
 WHEN 14 THEN concat('peer ', svc, ': certificate verify failed')
 WHEN 15 THEN concat('dns resolution failed for mail-', svc)
 WHEN 16 THEN concat('circuit breaker OPEN towards stock-', svc)
 WHEN 17 THEN concat('tenant ', n, ' is rate limited (429)')
 WHEN 18 THEN concat('block ', n, ': checksum mismatch after copy')
 WHEN 19 THEN concat('nightly batch ', n, ' finished')
 WHEN 20 THEN concat('session ', n, ': connection reset by peer')
 WHEN 21 THEN 'accept: too many open files'
 WHEN 22 THEN concat('report built in ', n, ' ms')
 WHEN 23 THEN concat('redis replica ', svc, ' reports an error while syncing')
 WHEN 24 THEN concat('cache warmed, ', n, ' keys')
 WHEN 25 THEN 'java.lang.NullPointerException: basket is null'
 WHEN 26 THEN concat('payment ', n, ' accepted, status ok')
 WHEN 27 THEN concat('retrying upload ', n, ' after a failure')
 WHEN 28 THEN concat('heartbeat of node ', svc)
 ELSE concat('config reloaded, revision ', n) END
"""

RAW_SQL = """
CASE event_id % 7
 WHEN 0 THEN concat(ts_iso, ' [', lvl, '] [svc', svc, '] ', msg)
 WHEN 1 THEN concat(ts_sp, ' ', lvl, ' ', msg)
 WHEN 2 THEN concat('{"ts":"', ts_iso, '","level":"', lower(lvl), '","msg":"', msg, '","host":"web-0', svc, '"}')
 WHEN 3 THEN concat(ts_sys, ' web0', svc, ' app[', n, ']: ', msg)
 WHEN 4 THEN concat('10.0.0.', svc, ' - - [', ts_clf, '] "GET /api/v1/x', svc, ' HTTP/1.1" ',
   CASE event_type WHEN 'error' THEN '503' WHEN 'purchase' THEN '404' WHEN 'signup' THEN '301' ELSE '200' END,
   ' ', n, ' "-" "curl/8"')
 WHEN 5 THEN concat('[', ts_sp, '] [', lvl, '] ', msg)
 ELSE concat('app: [', lower(lvl), '] ', msg) END
"""

# Second numbers of a dense clock, five events a second, with bursts of errors.
SECOND_SQL = "CAST(1704067200 + floor(event_id / 5.0) AS BIGINT)"
ERROR_SQL = "(event_id % 40 = 0 OR CAST(floor(event_id / 500.0) AS BIGINT) % 7 = 5)"

_SPARK_STAMPS = {
    "ts_iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
    "ts_sp": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "ts_sys": "date_format(ts, 'MMM dd HH:mm:ss')",
    "ts_clf": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss +0000')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def lines_from_events(events: DataFrame) -> DataFrame:
    """``(line_number, source, raw)``; works on a batch and on a streaming frame."""
    pieces = events.selectExpr(
        "event_id", "user_id", "event_type",
        "CAST(event_id % 4000 + 10 AS STRING) AS n",
        "CAST(user_id % 6 AS STRING) AS svc",
        f"{LEVEL_SQL} AS lvl",
        *[f"{sql} AS {name}" for name, sql in _SPARK_STAMPS.items()],
    )
    return pieces.selectExpr("*", f"{MESSAGE_SQL} AS msg").selectExpr(
        "event_id AS line_number",
        "concat('svc', svc, '.log') AS source",
        f"{RAW_SQL} AS raw",
    )


def spread(df: DataFrame) -> DataFrame:
    """Parsing is much more work than reading; a table that lies in fewer pieces than there
    are cores is dealt out first. A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_events(spread(table(spark, sf_dir, "events")))


def dense_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sec, n, err)``: lines and errors per second of the dense clock."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(f"{SECOND_SQL} AS sec", f"CAST({ERROR_SQL} AS INT) AS is_err")
        .groupBy("sec")
        .agg(F.count("*").alias("n"), F.sum("is_err").alias("err"))
    )
