"""Counts, shares, percentiles and the statistics snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.text import empty_to_null
from loomlog.operators import anomaly
from loomlog.operators.order import last_rows
from loomlog.operators.rates import (
    ERROR_SPAN,
    LINE_SPAN,
    MINUTE_SPAN,
    SERIES_SECONDS,
    covered_span,
    sparkline,
)

# Report sizes.
TOP_SOURCES = 10
TOP_CATEGORIES = 10
TOP_SIGNATURES = 12
REPORT_SIGNATURES = 10
LAST_ERRORS = 8
# ranges of a percentile: each holds about this share of the distinct values
PERCENTILE_RANGES = 200
BAR_CELLS = 40
# shares that names and seconds are first ranked in
RANK_SHARES = 64

# The place of an entry in the input: decides ties and "first seen".
ORDER = ("source", "line_number")


def input_order(df: DataFrame, order: Sequence[str] | None = None) -> Sequence[str]:
    """The order asked for, else by file and line; parsing may have changed the source."""
    if order is not None:
        return order
    return ("file", "line_number") if "file" in df.columns else ORDER


def totals(df: DataFrame) -> DataFrame:
    """Lines, errors, and the share of errors."""
    lines, errors = F.count("*"), F.count_if(F.col("is_error"))
    ratio = F.when(lines > 0, errors / lines).otherwise(F.lit(0.0))
    return df.agg(
        lines.alias("total_lines"), errors.alias("total_errors"), ratio.alias("error_ratio")
    ).withColumn("error_percent", F.col("error_ratio") * 100)


def level_counts(df: DataFrame) -> DataFrame:
    """A2, L4."""
    return df.groupBy("level_name").agg(F.count("*").alias("cnt")).orderBy("level_name")


def _top(df: DataFrame, name: str, n: int, order: Sequence[str] | None) -> DataFrame:
    """The n most frequent names; among equals the one seen first.

    Counted by name and all but the last order column first: the least of a number keeps that
    a hash aggregate, where the least of a whole place would sort every row.
    """
    *places, last = input_order(df, order)
    parts = df.groupBy(name, *[F.col(c).alias(f"_at_{c}") for c in places]).agg(
        F.count("*").alias("_n"), F.min(last).alias("_last")
    )
    seen = F.min(F.struct(*[f"_at_{c}" for c in places], "_last"))
    return (
        parts.groupBy(name)
        .agg(F.sum("_n").alias("cnt"), seen.alias("_seen"))
        .orderBy(F.desc("cnt"), F.asc("_seen"))
        .limit(n)
        .select(name, "cnt")
    )


def source_counts(
    df: DataFrame, n: int = TOP_SOURCES, order: Sequence[str] | None = None
) -> DataFrame:
    """A3."""
    return _top(df.filter(F.col("source") != ""), "source", n, order)


def error_level_counts(df: DataFrame) -> DataFrame:
    """A4."""
    return df.filter("is_error").groupBy("level_name").agg(F.count("*").alias("cnt"))


def top_signatures(
    df: DataFrame, n: int = TOP_SIGNATURES, order: Sequence[str] | None = None
) -> DataFrame:
    """The most frequent signatures among the errors."""
    errors = df.filter(F.col("is_error") & (F.col("fingerprint") != ""))
    return _top(errors, "fingerprint", n, order)


def share_of_peak(counts: DataFrame, cells: int = BAR_CELLS) -> DataFrame:
    """Each count against the largest, and as cells of a bar (at least one).

    ``counts`` is a short ranked list, such as a top-k result.
    """
    peak = F.max("cnt").over(Window.partitionBy())
    return counts.withColumn("share", F.col("cnt") / peak).withColumn(
        "cells", F.greatest(F.lit(1), F.bround(F.col("share") * cells, 0).cast("int"))
    )


def seen_window(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The timestamp texts of the earliest and latest entry with a known time."""
    order = input_order(df, order)
    known = F.when(F.col("ts_epoch") > 0, F.col("ts_epoch"))
    first = F.min_by("timestamp", F.when(known.isNotNull(), F.struct(known, *order)))
    last = F.min_by("timestamp", F.when(known.isNotNull(), F.struct(-known, *order)))
    return df.agg(
        F.coalesce(empty_to_null(first), F.lit("N/A")).alias("first_seen"),
        F.coalesce(empty_to_null(last), F.lit("N/A")).alias("last_seen"),
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Files and error signatures."""
    named = F.when(F.col("is_error") & (F.col("fingerprint") != ""), F.col("fingerprint"))
    return df.agg(
        F.count_distinct("source").alias("sources"), F.count_distinct(named).alias("signatures")
    )


def exact_percentiles(
    df: DataFrame, value: str, percents: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """A10: percentiles with linear interpolation, exact, without gathering the values.

    Equal values are counted first. Approximate quantiles of the distinct values cut them into
    ranges of about equal size, however close the values are. The counts are summed by range,
    which tells the range each wanted rank falls into; only the values of those ranges are then
    ranked. ``percent`` is clamped to 0..100. With
    no values at all the result is 0.0.
    """
    wanted = sorted({max(0.0, min(100.0, float(p))) for p in percents})
    x = F.col(value).cast("double")
    counted = (
        df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
        .groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    )
    cuts = [k / PERCENTILE_RANGES for k in range(1, PERCENTILE_RANGES)]
    edges = counted.groupBy(*by).agg(F.percentile_approx("_x", cuts, 10_000).alias("_edges"))
    if by:
        counted = counted.join(edges, list(by))
    else:
        counted = counted.withColumn("_edges", edges.scalar())
    below = F.size(F.filter("_edges", lambda edge: edge < F.col("_x")))
    counted = counted.withColumn("_range", below).drop("_edges")
    whole = Window.partitionBy(*by)
    running = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        counted.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
        .withColumns({
            "_upto": F.sum("_rows").over(running), "_total": F.sum("_rows").over(whole),
        })
        .withColumn("percent", F.explode(F.array(*[F.lit(p) for p in wanted])))
        .withColumn("_at", (F.col("_total") - 1) * (F.col("percent") / 100))
        .withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")})
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .filter((F.col("_low") < F.col("_upto")) & (F.col("_high") >= F.col("_before")))
    )
    inside = (
        Window.partitionBy(*by, "percent", "_range").orderBy("_x")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.join(ranges, [*by, "_range"]).withColumn(
        "_end", F.col("_before") + F.sum("_n").over(inside)
    )

    def value_at(rank: str) -> Column:
        here = (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_n"))
        return F.max(F.when(here, F.col("_x")))

    picked = ranked.groupBy(*by, "percent").agg(
        value_at("_low").alias("_a"), value_at("_high").alias("_b"),
        F.max("_at").alias("_at"), F.max("_low").alias("_low"), F.max("_high").alias("_high"),
    )
    between = F.col("_a") * (F.col("_high") - F.col("_at")) + F.col("_b") * (
        F.col("_at") - F.col("_low")
    )
    result = picked.select(
        *by, "percent",
        F.when(F.col("_low") == F.col("_high"), F.col("_a")).otherwise(between).alias("value"),
    )
    if by:
        return result
    asked = df.sparkSession.createDataFrame([(p,) for p in wanted], "percent double")
    return asked.join(result, "percent", "left").fillna(0.0, ["value"])


# -- percentiles from sketches ------------------------------------------------------------------

# the larger, the nearer the rank: within about 0.7 % at 400
SKETCH_SIZE = 400


def quantile_sketches(
    df: DataFrame, value: str, by: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """A10 at scale: one small sketch of the values per key, say per source and day.

    Sketches are kept and merged in place of values: a month's percentiles come from its days'
    sketches, and a day that is counted again replaces its own. Missing values are left out; a key with none has a
    null sketch.
    """
    x = F.col(value).cast("double")
    known = F.when(x.isNotNull() & ~F.isnan(x), x)
    return df.groupBy(*by).agg(
        F.kll_sketch_agg_double(known, F.lit(size)).alias("sketch"), F.count(known).alias("n")
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Fewer, wider sketches from ``(by, sketch, n)``."""
    filled = sketches.filter("n > 0")
    return filled.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n")
    )


def sketch_percentiles(sketches: DataFrame, percents: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, percent, value)`` by nearest rank, from sketches. ``percent`` is clamped to 0..100."""
    wanted = sorted({max(0.0, min(100.0, float(p))) for p in percents})
    percent = F.array(*map(F.lit, wanted)).alias("percent")
    ranks = F.array(*(F.lit(p / 100) for p in wanted))
    value = F.kll_sketch_get_quantile_double("sketch", ranks).alias("value")
    pairs = sketches.filter("n > 0").select(*by, percent, value)
    return pairs.select(*by, F.inline(F.arrays_zip("percent", "value")))


def snapshot(
    df: DataFrame,
    as_of: int | None = None,
    order: Sequence[str] | None = None,
    dropped: int | Column = 0,
) -> DataFrame:
    """The whole statistics as one row, from one pass over the entries.

    Grouping sets count levels, sources, signatures and seconds together, so the entries are
    parsed once and shuffled once, after partial counting. The counts are kept apart by all
    but the last order column, whose least value is a number: a hash aggregate. Lists are cut by
    rank in two steps: names and seconds are dealt into shares by hash, every share keeps its
    first ones, and only those are ranked together. A share also knows how many it had. Names are
    cut to the report's size, seconds to what the baseline looks back on. ``as_of`` defaults to the
    newest second. ``dropped`` is the number of lines that were lost before they were counted
    (T7), as ``lost_total`` of live tables knows it.

    Without entries every count and rate is zero and the baseline is the one to begin with.
    """
    second = F.when(F.col("ts_epoch") > 0, F.floor("ts_epoch").cast("bigint"))
    if as_of is not None:
        second = F.when(second <= as_of, second)
    *places, last = input_order(df, order)
    at = [f"at_{c}" for c in places]
    narrow = df.select(
        F.col("level_name").alias("level"),
        "source",
        F.when(F.col("is_error"), F.col("fingerprint")).alias("signature"),
        second.alias("second"),
        F.col("is_error").cast("int").alias("error"),
        *[F.col(c).alias(a) for c, a in zip(places, at)],
        F.col(last).alias("last"),
    )
    kind = (
        F.when(F.grouping("level") == 0, "level")
        .when(F.grouping("source") == 0, "source")
        .when(F.grouping("signature") == 0, "signature")
        .otherwise("second")
    )
    parts = narrow.groupingSets(
        [["level", *at], ["source", *at], ["signature", *at], ["second"]],
        "level", "source", "signature", "second", *at,
    ).agg(
        kind.alias("kind"), F.count("*").alias("n"), F.sum("error").alias("errors"),
        F.min("last").alias("last"),
    )
    counted = parts.groupBy(
        "kind", F.coalesce("level", "source", "signature").alias("name"), "second"
    ).agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"),
        F.min(F.struct(*at, "last")).alias("seen"),
    )
    ahead = (F.desc("second"), F.desc("n"), F.asc("seen"))
    share = Window.partitionBy("kind", "share")
    # a missing name counts as a source or signature no more than a missing time as a second
    winners = (
        counted.filter(
            (F.col("kind") == "level") | (F.coalesce("name", F.lit("")) != "")
            | F.col("second").isNotNull()
        )
        .withColumn("share", F.pmod(F.xxhash64("name", "second"), F.lit(RANK_SHARES)))
        .withColumns({
            "place": F.row_number().over(share.orderBy(*ahead)),
            "held": F.count("*").over(share),
            "_start": F.min("second").over(share),
        })
        .filter(F.col("place") <= anomaly.REACH)
        .withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(*ahead)))
    )
    newest = F.max("second").over(Window.partitionBy())
    now = newest if as_of is None else F.lit(as_of).cast("bigint")
    row = winners.withColumn("_now", now).agg(*_snapshot_names(), *_snapshot_clock())
    judged, moved = anomaly.baseline_at(F.col("clock"), F.col("start"), F.col("now"))
    rate = F.col("error_rate_per_min")
    return row.withColumns({"judged": judged, "baseline_rate": moved}).withColumns({
        "spike_ratio": rate / F.col("judged"),
        "spike_active": anomaly.spike_rule(rate, F.col("total_errors"), F.col("judged")),
        "dropped_lines": (F.lit(dropped) if isinstance(dropped, int) else dropped).cast("bigint"),
    }).drop("clock", "start", "now", "judged")


def _snapshot_names() -> list[Column]:
    """Totals, and the most frequent names as maps and lists."""
    is_level = F.col("kind") == "level"

    def named(which: str, limit: int | None = None, count: str = "n") -> Column:
        test = (F.col("kind") == which) & (F.col(count) > 0)
        if limit is not None:
            test &= F.col("rank") <= limit
        ordered = F.sort_array(
            F.collect_list(F.when(test, F.struct("rank", "name", F.col(count).alias("cnt"))))
        )
        return F.transform(ordered, lambda p: F.struct(p["name"].alias("name"), p["cnt"].alias("cnt")))

    signatures = F.when((F.col("kind") == "signature") & (F.col("place") == 1), F.col("held"))
    return [
        F.coalesce(F.sum(F.when(is_level, F.col("n"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(is_level, F.col("errors"))), F.lit(0)).alias("total_errors"),
        F.map_from_entries(named("level")).alias("level_counts"),
        F.map_from_entries(named("source", TOP_SOURCES)).alias("source_counts"),
        F.map_from_entries(named("level", count="errors")).alias("error_counts"),
        F.map_from_entries(named("signature", TOP_CATEGORIES)).alias("category_counts"),
        named("signature", TOP_SIGNATURES).alias("top_signatures"),
        F.coalesce(F.sum(signatures), F.lit(0)).alias("unique_errors"),
    ]


def _snapshot_clock() -> list[Column]:
    """Rates, the series, and the errors that the baseline is made of."""

    def inside(span: int) -> Column:
        return (F.col("kind") == "second") & (F.col("second") > F.col("_now") - span)

    def recent(count: str, span: int) -> Column:
        return F.coalesce(F.sum(F.when(inside(span), F.col(count))), F.lit(0))

    def covered(test: Column, span: int) -> Column:
        oldest = F.min(F.when(test & inside(span), F.col("second")))
        return covered_span(F.max("_now"), oldest, span)

    errors_60 = recent("errors", MINUTE_SPAN)
    counts = F.map_from_entries(
        F.collect_list(F.when(inside(SERIES_SECONDS), F.struct("second", "n")))
    )
    at = F.max("_now")
    series = F.transform(
        F.sequence(at - SERIES_SECONDS + 1, at),
        lambda s: F.coalesce(F.try_element_at(counts, s), F.lit(0)),
    )
    silent = F.array_repeat(F.lit(0).cast("bigint"), SERIES_SECONDS)
    error = F.struct(F.col("second").alias("sec"), F.col("errors").alias("err"))
    return [
        at.alias("now"),
        F.min("_start").alias("start"),
        (recent("n", LINE_SPAN) / covered(F.lit(True), LINE_SPAN)).alias("lines_per_sec"),
        F.coalesce(F.max(F.when(inside(SERIES_SECONDS), F.col("n"))), F.lit(0)).alias("peak_lines_per_sec"),
        errors_60.alias("errors_last_minute"),
        recent("errors", ERROR_SPAN).alias("errors_last_5m"),
        (errors_60 / covered(F.col("errors") > 0, MINUTE_SPAN) * 60).alias("error_rate_per_min"),
        sparkline(F.coalesce(series, silent), SERIES_SECONDS).alias("sparkline"),
        F.collect_list(F.when(inside(anomaly.REACH) & (F.col("errors") > 0), error)).alias("clock"),
    ]


def last_errors(df: DataFrame, n: int = LAST_ERRORS, order: Sequence[str] | None = None) -> DataFrame:
    """L1: the last errors, in input order."""
    order = input_order(df, order)
    newest = df.filter("is_error").orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.orderBy(*order)


def recent_rows(df: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """L2: the last ``n`` rows of the input, over all its files."""
    *places, last = input_order(df, order)
    return last_rows(df, n, last, places=places)


def latest_error(
    df: DataFrame, within: int | None = None, order: Sequence[str] | None = None
) -> DataFrame:
    """L3: the newest error, of the last ``within`` rows if that is given; no row if there is
    none."""
    order = input_order(df, order)
    rows = df if within is None else recent_rows(df, within, order)
    return rows.filter("is_error").orderBy(*(F.desc(c) for c in order)).limit(1)


def source_freshness(df: DataFrame, as_of: Column, stale_after: float) -> DataFrame:
    """Per source the newest event and line, and whether it has gone quiet."""
    newest = F.max(F.when(F.col("ts_epoch") > 0, F.col("ts_epoch")))
    return df.groupBy("source").agg(
        F.max("line_number").alias("last_line"),
        newest.alias("last_epoch"),
    ).withColumn(
        "is_stale",
        F.coalesce(F.unix_timestamp(as_of) - F.col("last_epoch") > stale_after, F.lit(True)),
    )
