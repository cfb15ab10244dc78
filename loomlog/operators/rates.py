"""Rates over the event clock.

Entries are counted per second first; everything after works on at most one row a second.
Look-back windows run inside stretches of the clock, each of which also gets the last rows of
the stretch before it, so no window ever orders the whole clock in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Look-back spans in seconds, and the sparkline.
LINE_SPAN = 60
MINUTE_SPAN = 60
ERROR_SPAN = 300
SERIES_SECONDS = 60
SPARK_CHARS = " ▁▂▃▄▅▆▇█"
SPARK_FLAT = 3

STRETCH = 3600


def per_second(
    df: DataFrame, arrived: Column | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """``(keys, sec, n, err)``. A line without a known time counts when it arrived."""
    arrived = F.unix_timestamp(F.current_timestamp()) if arrived is None else arrived
    sec = F.when(F.col("ts_epoch") > 0, F.floor("ts_epoch")).otherwise(arrived).cast("bigint")
    return df.groupBy(*keys, sec.alias("sec")).agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("err")
    )


def spread_over_stretches(
    df: DataFrame, offset: Column, width: int, reach: int, name: str
) -> DataFrame:
    """Give each row its stretch ``floor(offset / width)``; rows that the next stretch looks
    back on get that one too. ``is_own`` marks the row in its own stretch."""
    if width <= reach:
        raise ValueError("a stretch must hold the window that its first row looks back on")
    stretch = F.floor(offset / width).cast("bigint")
    needed_next = offset % width > width - 1 - reach
    homes = F.when(needed_next, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    return df.withColumns({"_stretch": stretch, name: F.explode(homes)}).withColumn(
        "is_own", F.col("_stretch") == F.col(name)
    ).drop("_stretch")


def covered_span(now: Column, oldest: Column, span: int) -> Column:
    """The seconds a window really covers; one if it holds nothing."""
    return F.greatest(
        F.coalesce(F.least(now - oldest + 1, F.lit(span)), F.lit(1)), F.lit(1)
    ).cast("double")


def rolling_rates(
    seconds: DataFrame, keys: Sequence[str] = (), stretch: int = STRETCH
) -> DataFrame:
    """For every second with lines, counts and rates of the windows ending there."""
    spread = spread_over_stretches(seconds, F.col("sec"), stretch, ERROR_SPAN - 1, "_part")
    clock = Window.partitionBy(*keys, "_part").orderBy("sec")
    lines = clock.rangeBetween(-(LINE_SPAN - 1), 0)
    minute = clock.rangeBetween(-(MINUTE_SPAN - 1), 0)
    five = clock.rangeBetween(-(ERROR_SPAN - 1), 0)
    error_sec = F.when(F.col("err") > 0, F.col("sec"))
    now = F.col("sec")
    wide = spread.withColumns({
        "lines_60s": F.sum("n").over(lines),
        "errors_60s": F.sum("err").over(minute),
        "errors_300s": F.sum("err").over(five),
        "_oldest": F.min("sec").over(lines),
        "_oldest_err": F.min(error_sec).over(minute),
        "_oldest_err_300": F.min(error_sec).over(five),
    }).filter("is_own")
    return wide.select(
        *keys, "sec", "n", "err", "lines_60s", "errors_60s", "errors_300s",
        (F.col("lines_60s") / covered_span(now, F.col("_oldest"), LINE_SPAN))
        .alias("lines_per_sec"),
        (F.col("errors_300s") / covered_span(now, F.col("_oldest_err_300"), ERROR_SPAN))
        .alias("errors_per_sec"),
        (F.col("errors_60s") / covered_span(now, F.col("_oldest_err"), MINUTE_SPAN) * 60)
        .alias("errors_per_min"),
    )


def _newest(seconds: DataFrame, as_of: int | None, span: int) -> DataFrame:
    """The rows of the last ``span`` seconds with the moment ``now``: at most ``span`` rows,
    found by an ordered limit rather than by sorting the clock."""
    if as_of is not None:
        recent = seconds.filter((F.col("sec") > as_of - span) & (F.col("sec") <= as_of))
        return recent.withColumn("now", F.lit(as_of).cast("bigint"))
    recent = seconds.orderBy(F.desc("sec")).limit(span)
    recent = recent.withColumn("now", F.max("sec").over(Window.partitionBy()))
    return recent.filter(F.col("sec") > F.col("now") - span)


def current_rates(seconds: DataFrame, as_of: int | None = None) -> DataFrame:
    """lines/s over 60 s and errors/s over 300 s at one moment (default: the newest)."""
    recent = _newest(seconds, as_of, ERROR_SPAN)
    in_lines = F.col("sec") > F.col("now") - LINE_SPAN
    now = F.coalesce(F.max("now"), F.lit(as_of or 0))
    lines = F.coalesce(F.sum(F.when(in_lines, F.col("n"))), F.lit(0))
    errors = F.coalesce(F.sum("err"), F.lit(0))
    oldest_line = F.min(F.when(in_lines, F.col("sec")))
    oldest_error = F.min(F.when(F.col("err") > 0, F.col("sec")))
    return recent.agg(
        (lines / covered_span(now, oldest_line, LINE_SPAN)).alias("lines_per_sec"),
        (errors / covered_span(now, oldest_error, ERROR_SPAN)).alias("errors_per_sec"),
    )


def last_series(
    seconds: DataFrame, as_of: int | None = None, buckets: int = SERIES_SECONDS
) -> DataFrame:
    """``(sec, n)`` for each of the last seconds, zero where nothing was logged."""
    recent = _newest(seconds, as_of, buckets)
    filled = recent.agg(
        F.coalesce(F.max("now"), F.lit(as_of)).alias("now"),
        F.map_from_entries(F.collect_list(F.struct("sec", "n"))).alias("counts"),
    )
    grid = filled.withColumn("sec", F.explode(F.sequence(F.col("now") - buckets + 1, "now")))
    return grid.select(
        "sec", F.coalesce(F.try_element_at("counts", F.col("sec")), F.lit(0)).alias("n")
    )


def peak_rate(series: DataFrame) -> DataFrame:
    """The highest count of a series."""
    return series.agg(F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("peak"))


def sparkline(values: Column, width: int = 60) -> Column:
    """Numbers as a line of blocks scaled to their range, the last ``width`` of them."""
    last = F.when(F.size(values) > width, F.slice(values, -width, width)).otherwise(values)
    low, high = F.array_min(last), F.array_max(last)
    top = len(SPARK_CHARS) - 1
    flat = F.when(high <= 0, SPARK_CHARS[0]).otherwise(SPARK_CHARS[SPARK_FLAT])
    scaled = F.transform(
        last,
        lambda v: F.substr(
            F.lit(SPARK_CHARS),
            F.greatest(
                F.lit(0),
                F.least(F.lit(top), F.floor((v - low) / (high - low).cast("double") * top)),
            ).cast("int") + 1,
            F.lit(1),
        ),
    )
    return (
        F.when(F.size(last) == 0, "")
        .when(low == high, F.array_join(F.transform(last, lambda _: flat), ""))
        .otherwise(F.array_join(scaled, ""))
    )


def series_sparkline(series: DataFrame, width: int = SERIES_SECONDS) -> DataFrame:
    """W9 over a series of a few seconds, as one row."""
    ordered = F.array_sort(F.collect_list(F.struct("sec", "n")))
    counts = series.agg(F.transform(ordered, lambda p: p["n"]).alias("counts"))
    return counts.select(sparkline(F.col("counts"), width).alias("sparkline"))
