"""Error spikes against a slowly moving baseline.

Every five seconds of the event clock the error rate is compared with an exponentially
weighted mean of the rates before it. The recursion

    baseline = (1 - a) * baseline + a * max(rate, 1)

is a weighted sum, so a chunk of ticks is computed by one running sum, and chunks are tied
together by their end values. Only ticks with errors in their last minute are computed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.rates import MINUTE_SPAN, covered_span

# The spike rule.
SPIKE_RATIO = 3.0
SPIKE_RATE = 5.0
SPIKE_ERRORS = 10
TICK_SECONDS = 5
BASELINE_TAU = 30.0
BASELINE_START = 0.5
OBSERVED_FLOOR = 1.0

KEEP = math.exp(-TICK_SECONDS / BASELINE_TAU)
# Older ticks weigh less than 1e-17 of the baseline.
MEMORY_TICKS = 240
CHUNK_TICKS = 2000
# seconds a baseline looks back on
REACH = MEMORY_TICKS * TICK_SECONDS + MINUTE_SPAN


def spike_rule(rate: Column, errors: Column, baseline: Column) -> Column:
    """Enough errors a minute, enough errors at all, and a multiple of the baseline."""
    return (
        (rate >= SPIKE_RATE) & (errors >= SPIKE_ERRORS) & (rate / baseline >= SPIKE_RATIO)
    )


def baseline_at(errors: Column, start: Column, now: Column) -> tuple[Column, Column]:
    """The baseline that a moment is judged by and the one it leaves, from one row.

    ``errors`` holds ``(sec, err)`` of at least the last ``REACH`` seconds, ``start`` is the first
    second of the clock. A moment between two ticks moves nothing. The same sum as in
    ``spike_ticks``, over the ticks of its memory.
    """

    def rate_at(second: Column) -> Column:
        inside = F.filter(errors, lambda e: (e["sec"] > second - MINUTE_SPAN) & (e["sec"] <= second))
        total = F.aggregate(inside, F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e["err"])
        oldest = F.array_min(F.transform(inside, lambda e: e["sec"]))
        return total / covered_span(second, oldest, MINUTE_SPAN) * 60

    since = now - start
    last = F.floor(since / TICK_SECONDS).cast("bigint")
    at_tick = (last > 0) & (since % TICK_SECONDS == 0)
    done = last - at_tick.cast("bigint")
    ticks = F.when(done > 0, F.sequence(F.greatest(F.lit(1), done - MEMORY_TICKS + 1), done)).otherwise(
        F.array().cast("array<bigint>")
    )
    pushed = F.aggregate(
        ticks, F.lit(0.0),
        lambda sum_, k: sum_ + (1 - KEEP) * F.pow(F.lit(KEEP), done - k)
        * (F.greatest(rate_at(start + k * TICK_SECONDS), F.lit(OBSERVED_FLOOR)) - OBSERVED_FLOOR),
    )
    first = F.pow(F.lit(KEEP), done) * (BASELINE_START - OBSERVED_FLOOR)
    before = F.coalesce(OBSERVED_FLOOR + first + pushed, F.lit(BASELINE_START))
    moved = KEEP * before + (1 - KEEP) * F.greatest(rate_at(now), F.lit(OBSERVED_FLOOR))
    return before, F.when(at_tick, moved).otherwise(before)


def spike_ticks(
    seconds: DataFrame,
    keys: Sequence[str] = (),
    chunk_ticks: int = CHUNK_TICKS,
    memory_ticks: int = MEMORY_TICKS,
) -> DataFrame:
    """One row per tick with an error in its last minute, from ``(keys, sec, n, err)``.

    Ticks lie every five seconds after a key's first second. In silent ticks the rate is zero
    and the baseline only falls back towards its floor, by a fixed factor each; they are not
    rows, so the result grows with the errors and not with the clock. ``baseline`` is the one
    the tick is judged by, ``next_baseline`` the one it leaves. Chunks that end more than
    ``memory_ticks`` before a chunk begins have no part in it.
    """
    start = seconds.groupBy(*keys).agg(
        F.min("sec").alias("_start"), F.max("sec").alias("_end")
    )
    placed = seconds.join(start, list(keys)) if keys else _with_start(seconds, start)
    since = F.col("sec") - F.col("_start")
    ticks = [*keys, "_start", "_tick"]
    touched = (
        placed.filter("err > 0")
        .withColumns({
            "_from": F.greatest(F.ceil(since / TICK_SECONDS), F.lit(1)).cast("bigint"),
            "_to": F.least(
                F.floor((since + MINUTE_SPAN - 1) / TICK_SECONDS),
                F.floor((F.col("_end") - F.col("_start")) / TICK_SECONDS),
            ).cast("bigint"),
        })
        .filter("_from <= _to")
        .withColumn("_tick", F.explode(F.sequence("_from", "_to")))
        .groupBy(*ticks)
        .agg(
            F.sum("err").cast("bigint").alias("_err60"),
            F.min("sec").alias("_oldest"),
            F.sum(F.when(F.col("_tick") == F.col("_from"), F.col("err")).otherwise(0))
            .cast("bigint").alias("_new"),
        )
    )
    second = F.col("_start") + F.col("_tick") * TICK_SECONDS
    rate = F.col("_err60") / covered_span(second, F.col("_oldest"), MINUTE_SPAN) * 60
    chunk = F.floor((F.col("_tick") - 1) / chunk_ticks)
    # what a tick adds to the baseline's distance from its floor
    pushed = (1 - KEEP) * (F.greatest(rate, F.lit(OBSERVED_FLOOR)) - OBSERVED_FLOOR)
    judged = touched.withColumns({
        "sec": second, "errors_per_min": rate, "_chunk": chunk,
        "_j": F.col("_tick") - chunk * chunk_ticks,
    }).withColumn("_lifted", pushed * F.pow(F.lit(KEEP), -F.col("_j")))

    # within a chunk: running sums, each push lifted by its age
    by_tick = Window.partitionBy(*keys, "_chunk").orderBy("_j")
    before = by_tick.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_tick.rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumns({
        "_before": F.coalesce(F.sum("_lifted").over(before), F.lit(0.0)),
        "_after": F.sum("_lifted").over(upto),
        "_sofar": F.sum("_new").over(upto),
    })

    # between chunks that have ticks: their last values, faded by the chunks that lie between
    ends = judged.groupBy(*keys, "_chunk").agg(
        (F.sum("_lifted") * KEEP**chunk_ticks).alias("_push"), F.sum("_new").alias("_errors_in")
    )
    order = Window.partitionBy(*keys).orderBy("_chunk")
    memory = math.ceil(memory_ticks / chunk_ticks)
    earlier = F.collect_list(F.struct("_chunk", "_push")).over(order.rangeBetween(-memory, -1))
    factor = F.lit(KEEP**chunk_ticks)
    carried = ends.select(
        *keys, "_chunk",
        F.coalesce(
            F.sum("_errors_in").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_errors_before"),
        F.aggregate(
            earlier, F.lit(0.0),
            lambda sum_, e: sum_
            + e["_push"] * F.pow(factor, F.col("_chunk") - e["_chunk"] - 1),
        ).alias("_carry"),
    )
    joined = judged.join(carried, [*keys, "_chunk"])

    def baseline(steps: int, local: str) -> Column:
        faded = F.pow(F.lit(KEEP), F.col("_j") + steps) * (F.col("_carry") + F.col(local))
        first = F.pow(F.lit(KEEP), F.col("_tick") + steps) * (BASELINE_START - OBSERVED_FLOOR)
        return OBSERVED_FLOOR + first + faded

    return joined.select(
        *keys, F.col("sec").alias("tick"), "errors_per_min",
        (F.col("_errors_before") + F.col("_sofar")).alias("total_errors"),
        baseline(-1, "_before").alias("baseline"), baseline(0, "_after").alias("next_baseline"),
    ).withColumns({
        "spike_ratio": F.col("errors_per_min") / F.col("baseline"),
        "is_spike": spike_rule(
            F.col("errors_per_min"), F.col("total_errors"), F.col("baseline")
        ),
    })


def _with_start(seconds: DataFrame, start: DataFrame) -> DataFrame:
    """Without keys the clock has one start and end: two scalars."""
    return seconds.withColumns({
        "_start": start.select("_start").scalar(), "_end": start.select("_end").scalar(),
    })
