"""Queries over rates and spikes on the event clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import anomaly, rates
from loomlog.plans import check_base as sql
from loomlog.plans.parsing import parsed
from loomlog.sources.tables import ERROR_SQL, SECOND_SQL, as_of, dense_seconds, table


def per_second(spark, sf_dir):
    entries = parsed(spark, sf_dir, "ts_epoch", "is_error")
    return rates.per_second(entries, arrived=F.unix_timestamp(as_of()))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def rolling_rates(spark, sf_dir):
    found = rates.rolling_rates(dense_seconds(spark, sf_dir), stretch=600)
    return _rounded(found, "lines_per_sec", "errors_per_sec", "errors_per_min")


def _covered(oldest, span):
    return f"greatest(1, coalesce(least(sec - {oldest} + 1, {span}), 1))"


_ROLLING = sql.with_seconds(f"""SELECT sec, n, err, lines_60s, errors_60s, errors_300s,
  round(lines_60s / {_covered('o60', 60)}, 6) AS lines_per_sec,
  round(errors_300s / {_covered('e300', 300)}, 6) AS errors_per_sec,
  round(errors_60s / {_covered('e60', 60)} * 60, 6) AS errors_per_min
FROM (SELECT *,
    CAST(sum(n) OVER m AS BIGINT) AS lines_60s, CAST(sum(err) OVER m AS BIGINT) AS errors_60s,
    CAST(sum(err) OVER f AS BIGINT) AS errors_300s, min(sec) OVER m AS o60,
    min(CASE WHEN err > 0 THEN sec END) OVER m AS e60,
    min(CASE WHEN err > 0 THEN sec END) OVER f AS e300
  FROM seconds
  WINDOW m AS (ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW),
         f AS (ORDER BY sec RANGE BETWEEN 299 PRECEDING AND CURRENT ROW))""")


def current_rates(spark, sf_dir):
    return _rounded(
        rates.current_rates(dense_seconds(spark, sf_dir)), "lines_per_sec", "errors_per_sec"
    )


_CURRENT = sql.with_seconds("""SELECT
  round(sum(n) FILTER (WHERE sec > now - 60)
    / greatest(1, least(max(now) - min(sec) FILTER (WHERE sec > now - 60) + 1, 60)), 6) AS lines_per_sec,
  round(coalesce(sum(err) FILTER (WHERE sec > now - 300)
    / greatest(1, least(max(now) - min(sec) FILTER (WHERE sec > now - 300 AND err > 0) + 1, 300)), 0), 6)
    AS errors_per_sec
FROM (SELECT *, (SELECT max(sec) FROM seconds) AS now FROM seconds)""")

# A moment shortly after the newest second: the series ends in zeros.
_LATER = 1704067200 + 2_010


def last_series(spark, sf_dir):
    return rates.last_series(dense_seconds(spark, sf_dir), as_of=_LATER)


_SERIES = """, series AS (SELECT g.sec AS sec, coalesce(s.n, 0) AS n
  FROM (SELECT unnest(range({0} - 59, {0} + 1)) AS sec) g LEFT JOIN seconds s ON s.sec = g.sec)"""


def peak_rate(spark, sf_dir):
    return rates.peak_rate(rates.last_series(dense_seconds(spark, sf_dir)))


def _hourly(spark, sf_dir):
    """Lines per hour of the log's own clock, by event type: uneven series."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_type", "date_trunc('DAY', ts) AS day"
    ).groupBy("event_type", "day").count()


def sparklines(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("day", "count")))
    series = _hourly(spark, sf_dir).groupBy("event_type").agg(
        F.transform(ordered, lambda p: p["count"]).alias("counts")
    )
    return series.select(
        "event_type", rates.sparkline(F.col("counts"), 20).alias("sparkline"),
        rates.sparkline(F.array(F.lit(5), F.lit(5))).alias("flat"),
    )


_SPARKLINES = f"""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n
  FROM events GROUP BY ALL),
last20 AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 20),
ranged AS (SELECT *, min(n) OVER (PARTITION BY event_type) AS lo, max(n) OVER (PARTITION BY event_type) AS hi
  FROM last20)
SELECT event_type, string_agg(CASE WHEN hi = lo THEN CASE WHEN hi <= 0 THEN ' ' ELSE '▃' END ELSE
  substr({sql.q(rates.SPARK_CHARS)}, CAST(floor((n - lo) / (hi - lo) * 8) AS INT) + 1, 1) END,
  '' ORDER BY day) AS sparkline, '▃▃' AS flat
FROM ranged GROUP BY event_type"""


def series_sparkline(spark, sf_dir):
    return rates.series_sparkline(rates.last_series(dense_seconds(spark, sf_dir), as_of=_LATER))


_SERIES_SPARK = sql.with_seconds(
    f"""SELECT string_agg(CASE WHEN hi = lo THEN CASE WHEN hi <= 0 THEN ' ' ELSE '▃' END ELSE substr({sql.q(rates.SPARK_CHARS)},
  CAST(floor((n - lo) / (hi - lo) * 8) AS INT) + 1, 1) END, '' ORDER BY sec) AS sparkline
FROM (SELECT *, min(n) OVER () AS lo, max(n) OVER () AS hi FROM series)""",
    _SERIES.format(_LATER),
)


def _tick_columns(df, *keys):
    return df.select(
        *keys, "tick", F.round("errors_per_min", 6).alias("errors_per_min"), "total_errors",
        F.round("baseline", 6).alias("baseline"), F.round("spike_ratio", 6).alias("spike_ratio"),
        "is_spike",
    )


def spike_ticks(spark, sf_dir):
    return _tick_columns(anomaly.spike_ticks(dense_seconds(spark, sf_dir), chunk_ticks=100))


def spike_ticks_by_user(spark, sf_dir):
    """The same rule for every group of users on its own."""
    seconds = (
        table(spark, sf_dir, "events")
        .selectExpr("user_id % 7 AS grp", f"{SECOND_SQL} AS sec", f"CAST({ERROR_SQL} AS INT) AS e")
        .groupBy("grp", "sec").agg(F.count("*").alias("n"), F.sum("e").alias("err"))
    )
    return _tick_columns(anomaly.spike_ticks(seconds, keys=["grp"]), "grp")


def _ticks_check(key, seconds):
    keep = repr(anomaly.KEEP)
    return f"""WITH RECURSIVE {seconds},
bounds AS (SELECT {key}, min(sec) AS a, max(sec) AS b FROM seconds GROUP BY {key}),
ticks AS (SELECT {key}, a, unnest(range(1, (b - a) // 5 + 1)) AS k FROM bounds),
joined AS (
  SELECT t.{key}, t.k, t.a + 5 * t.k AS tick,
    coalesce(sum(s.err) FILTER (WHERE s.sec > t.a + 5 * t.k - 60), 0) AS e60,
    min(s.sec) FILTER (WHERE s.sec > t.a + 5 * t.k - 60) AS oldest,
    coalesce(sum(s.err), 0) AS total
  FROM ticks t LEFT JOIN (SELECT * FROM seconds WHERE err > 0) s
    ON s.{key} = t.{key} AND s.sec <= t.a + 5 * t.k
  GROUP BY t.{key}, t.k, t.a),
rated AS MATERIALIZED (
  SELECT {key}, k, tick, CAST(total AS BIGINT) AS total_errors,
    e60 / greatest(1, coalesce(least(tick - oldest + 1, 60), 1)) * 60 AS rate FROM joined),
walk AS (
  SELECT {key}, k, tick, total_errors, rate, CAST(0.5 AS DOUBLE) AS baseline FROM rated WHERE k = 1
  UNION ALL
  SELECT r.{key}, r.k, r.tick, r.total_errors, r.rate,
    {keep} * w.baseline + (1 - {keep}) * greatest(w.rate, 1.0)
  FROM walk w JOIN rated r ON r.{key} = w.{key} AND r.k = w.k + 1)
SELECT {key}, tick, round(rate, 6) AS errors_per_min, total_errors, round(baseline, 6) AS baseline,
  round(rate / baseline, 6) AS spike_ratio,
  rate >= 5 AND total_errors >= 10 AND rate / baseline >= 3 AS is_spike
FROM walk WHERE rate > 0"""


_KEYED = f"""seconds AS (SELECT user_id % 7 AS grp, {SECOND_SQL} AS sec,
  CAST(count(*) FILTER (WHERE {ERROR_SQL}) AS BIGINT) AS err FROM events GROUP BY ALL)"""
_ONE = f"""seconds AS (SELECT 0 AS one, {SECOND_SQL} AS sec,
  CAST(count(*) FILTER (WHERE {ERROR_SQL}) AS BIGINT) AS err FROM events GROUP BY ALL)"""


QUERIES = {
    "per_second": (per_second, sql.with_entries(
        f"""SELECT CASE WHEN ts_epoch > 0 THEN CAST(floor(ts_epoch) AS BIGINT)
    ELSE CAST(epoch(TIMESTAMP '{sql.AS_OF}') AS BIGINT) END AS sec, count(*) AS n,
  count(*) FILTER (WHERE is_error) AS err FROM entries GROUP BY 1""")),
    "rolling_rates": (rolling_rates, _ROLLING),
    "current_rates": (current_rates, _CURRENT),
    "last_series": (
        last_series, sql.with_seconds("SELECT sec, n FROM series", _SERIES.format(_LATER))
    ),
    "peak_rate": (peak_rate, sql.with_seconds(
        """SELECT CAST(max(n) AS DOUBLE) AS peak FROM seconds
WHERE sec > (SELECT max(sec) - 60 FROM seconds)""")),
    "sparklines": (sparklines, _SPARKLINES),
    "series_sparkline": (series_sparkline, _SERIES_SPARK),
    "spike_ticks": (
        spike_ticks,
        _ticks_check("one", _ONE).replace("SELECT one, tick, round(rate", "SELECT tick, round(rate"),
    ),
    "spike_ticks_by_user": (spike_ticks_by_user, _ticks_check("grp", _KEYED)),
}
