"""The operators on live logs (T1-T10), with Structured Streaming.

Logs arrive as finished segments: files that are moved into a folder and not changed any
more. The checkpoint remembers what was read, so nothing is lost or read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from loomlog.operators import anomaly
from loomlog.operators.diagnose import diagnose
from loomlog.operators.order import last_rows, with_context
from loomlog.operators.parse import parse_logs
from loomlog.sinks.versions import Versions
from loomlog.sources.tables import spread
from loomlog.sources.textlogs import decode_text, drop_blank


def read_live(
    spark: SparkSession,
    folder: str,
    files_per_trigger: int = 1000,
    start_at: str | None = None,
    encoding: str = "utf-8",
    log: Column | None = None,
) -> DataFrame:
    """Lines ``(raw, source, line_number, arrival)`` of the segments in a folder.

    The source is the segment's whole path, the arrival the time it was last changed.
    ``start_at`` skips segments last changed before that moment. Lines of a segment are not
    numbered unless ``log`` names the log it belongs to, as an expression over ``source``:
    then the lines, blank ones too, have their ``log`` and ``block`` for ``tables.number_lines``.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    if start_at is not None:
        since = F.lit(start_at).cast("timestamp")
        lines = lines.filter(F.col("_metadata.file_modification_time") >= since)
    read = lines.select(
        decode_text(F.col("value"), encoding).alias("raw"),
        F.col("_metadata.file_path").alias("source"),
        F.lit(0).cast("bigint").alias("line_number"),
        F.col("_metadata.file_modification_time").alias("arrival"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    if log is None:
        return drop_blank(read.drop("block"))
    return read.drop("line_number").withColumn("log", log)


def running_counts(entries: DataFrame, by: str) -> DataFrame:
    """Totals so far by level, source or signature; for ``update`` or ``complete``."""
    return entries.groupBy(by).agg(F.count("*").alias("cnt"))


def second_counts(
    entries: DataFrame, watermark: str = "10 minutes", keys: Sequence[str] = ()
) -> DataFrame:
    """T4: lines and errors per second. Late lines count until the watermark has passed.

    A line without a time counts at its ``arrival``, a column of ``read_live``, or else when
    its batch runs; ``filled`` says how many of a second's lines did. Old logs read with their
    own time need an arrival of that time too, or the batch's clock makes all of them late.
    """
    arrival = F.col("arrival") if "arrival" in entries.columns else F.current_timestamp()
    when = F.coalesce(F.col("event_time").cast("timestamp"), arrival)
    return (
        entries.withColumns({"_when": when, "_filled": F.col("event_time").isNull()})
        .withWatermark("_when", watermark)
        .groupBy(F.window("_when", "1 second"), *keys)
        .agg(
            F.count("*").alias("n"), F.count_if("is_error").alias("err"),
            F.count_if("_filled").alias("filled"),
        )
    )


def sliding_counts(seconds: DataFrame, span: int, keys: Sequence[str] = ()) -> DataFrame:
    """T4: counts of the last ``span`` seconds, every second.

    Slides over the per-second counts, not over the lines: only one row a second is
    multiplied by the span.
    """
    slid = F.window(F.window_time("window"), f"{span} seconds", "1 second")
    return seconds.groupBy(slid, *keys).agg(F.sum("n").alias("n"), F.sum("err").alias("err"))


def flat_seconds(seconds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, sec, n, err)`` from windowed counts."""
    return seconds.select(
        *keys, F.unix_timestamp(F.col("window.start")).alias("sec"), "n", "err"
    )


# -- live spikes (T5) --------------------------------------------------------------------------

_TICKS = (
    "tick long, errors_per_min double, total_errors long, baseline double, "
    "next_baseline double, spike_ratio double, is_spike boolean"
)
# a key that logs nothing for so long is forgotten
IDLE_SECONDS = 86_400
_STORE = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state."
_HDFS, _ROCKS = f"{_STORES}HDFSBackedStateStoreProvider", f"{_STORES}RocksDBStateStoreProvider"


def _spike_processor(kind: str, idle: int):
    """The stateful processor of one key. It closes over plain numbers only, so that it travels
    to Python workers by value and they need not have this package installed."""
    every, span, keep = anomaly.TICK_SECONDS, anomaly.MINUTE_SPAN, anomaly.KEEP
    first_baseline, floor = anomaly.BASELINE_START, anomaly.OBSERVED_FLOOR
    least_rate, least_errors = anomaly.SPIKE_RATE, anomaly.SPIKE_ERRORS
    least_ratio, chunk = anomaly.SPIKE_RATIO, anomaly.CHUNK_TICKS
    columns = ["key0"] + [c.split()[0] for c in _TICKS.split(", ")]

    def judged(start, done, last, baseline, total, sec, err):
        """Ticks ``done + 1 .. last`` that have an error in their last minute, as columns, and
        the baseline after the last one. Whole arrays at a time, by chunks of the clock."""
        sums = np.r_[0, np.cumsum(err)]
        low = np.maximum(-(-(sec - start) // every), done + 1)
        high = np.minimum((sec - start + span - 1) // every, last)
        touched = [np.arange(a, b + 1) for a, b in zip(low, high) if a <= b]
        ticks = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        at = start + ticks * every
        upto, since = np.searchsorted(sec, at, "right"), np.searchsorted(sec, at - span, "right")
        reach = np.minimum(at - sec[np.minimum(since, len(sec) - 1)] + 1, span) if len(ticks) else at
        rate = (sums[upto] - sums[since]) / np.maximum(1.0, reach) * 60
        pushed = (1 - keep) * (np.maximum(rate, floor) - floor)
        before, after = np.zeros(len(ticks)), np.zeros(len(ticks))
        apart, begin, since_part = baseline - floor, done + 1, 0
        for part in np.unique((ticks - begin) // chunk):
            here = np.flatnonzero((ticks - begin) // chunk == part)
            place = ticks[here] - (begin + part * chunk)
            lifted = np.cumsum(pushed[here] * keep ** -(place + 1.0))
            faded = apart * keep ** float((part - since_part) * chunk)
            before[here] = floor + keep ** (place * 1.0) * (faded + np.r_[0, lifted[:-1]])
            after[here] = floor + keep ** (place + 1.0) * (faded + lifted)
            # as if the chunk's pushes had been there from its beginning; from the beginning of
            # the clock they would be beyond all numbers after some hours
            apart, since_part = faded + lifted[-1], part
        ended = floor + keep ** float(last - done - since_part * chunk) * apart
        new = sums[upto] - sums[np.searchsorted(sec, counted_to(start, done), "right")]
        return at, rate, total + new, before, after, ended

    def counted_to(start, done):
        """The second up to which errors have been counted; none before the first tick."""
        return start + done * every if done else start - 1

    class Spikes(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.clock = handle.getValueState("clock", "start long, done long, baseline double, total long")
            self.recent = handle.getListState("recent", "sec long, err long")

        def handleInputRows(self, key, rows, timerValues):
            frame = pd.concat(list(rows))
            until = int(frame["sec"].max())
            hit = frame[frame["err"] > 0]
            sec, err = hit["sec"].to_numpy(np.int64), hit["err"].to_numpy(np.int64)
            if self.clock.exists():
                start, done, baseline, total = self.clock.get()
                listed = self.recent.get() if self.recent.exists() else ()
                held = np.array([tuple(r) for r in listed], np.int64).reshape(-1, 2)
                sec, err = np.r_[held[:, 0], sec], np.r_[held[:, 1], err]
            else:
                start, done, baseline, total = int(frame["sec"].min()), 0, first_baseline, 0
            order = np.argsort(sec, kind="stable")
            sec, err = sec[order], err[order]
            last = max(done, (until - start) // every)
            at, rate, counted, before, after, ended = judged(
                start, done, last, baseline, total, sec, err
            )
            new = (sec > counted_to(start, done)) & (sec <= counted_to(start, last))
            total += int(err[new].sum())
            self.clock.update((int(start), int(last), float(ended), int(total)))
            # seconds beyond the last tick have not been counted yet
            kept = sec > counted_to(start, last) - span
            if kept.any():
                self.recent.put([(int(s), int(e)) for s, e in zip(sec[kept], err[kept])])
            else:  # a list in the state is never empty
                self.recent.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((until + idle) * 1000)
            ratio = rate / before
            spike = (rate >= least_rate) & (counted >= least_errors) & (ratio >= least_ratio)
            names = np.full(len(at), key[0], object)
            yield pd.DataFrame(
                dict(zip(columns, (names, at, rate, counted, before, after, ratio, spike)))
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            """The key has been idle: it leaves the state, and is a new one if it comes back."""
            self.clock.clear()
            self.recent.clear()
            return iter(())

        def close(self):
            pass

    return Spikes()


def live_spikes(
    flat: DataFrame, key: str = "source", idle: int = IDLE_SECONDS, delay: str = "0 seconds"
) -> DataFrame:
    """T5: the spike rule on a stream of closed seconds ``(key, sec, n, err)``.

    The input has at most one row per key and second, so a key that holds most lines costs no
    more than any other. State per key: the clock, the baseline and a list of a minute of
    error counts. A key without rows for ``idle`` seconds of the stream's clock leaves the state.
    Sets the session's state store to RocksDB, which such state needs, where it is unset.
    """
    spark = flat.sparkSession
    if spark.conf.get(_STORE, _HDFS) == _HDFS:
        spark.conf.set(_STORE, _ROCKS)
    kind = flat.schema[key].dataType.simpleString()
    return (
        flat.withColumn("_at", F.timestamp_seconds("sec"))
        .withWatermark("_at", delay)
        .groupBy(key)
        .transformWithStateInPandas(
            _spike_processor(kind, idle), f"key0 {kind}, {_TICKS}", "append", "EventTime"
        )
        .withColumnRenamed("key0", key)
    )


# -- running queries ---------------------------------------------------------------------------


class LateRows(StreamingQueryListener):
    """Rows that came after their watermark and were left out, by query.

    Every batch's report is added up as it comes, so none is forgotten however many there are.
    Add it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.counts[str(progress.id)] = self.counts.get(str(progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.counts.get(str(query.id), 0)


def start_table(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Start writing a stream to a Parquet table, to the end of what is there or for ever.

    In ``complete`` mode every batch is a whole result in a folder of its own, so that readers
    always find one: read it with ``latest_table``.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if mode == "append":
        return writer.outputMode("append").format("parquet").start(path)

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return writer.outputMode("complete").foreachBatch(add).start()


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest result that a stream in ``complete`` mode has written."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch_id")).scalar()
    return rows.filter(F.col("batch_id") == newest).drop("batch_id")


def start_diagnosis(
    lines: DataFrame,
    entries_path: str,
    diagnoses_path: str,
    checkpoint: str,
    half: int = 6,
    as_of: Column | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Diagnose new errors as they arrive, with the lines around them.

    Each batch is first written to the entries table, under its own number. A batch that is
    run again after a failure replaces what it wrote before, and the diagnosis reads a fixed
    table instead of parsing the lines once per use. The last ``half`` lines of each log are
    kept beside the entries, so an error at the head of a batch sees the lines before it. All
    lines of a landing folder are one log: give ``lines`` a ``source`` that lasts over segments.
    A line may name another source; ``log`` keeps the one it was landed with.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"{entries_path}/batch_id={batch_id}"
        tails = Versions(f"{entries_path}_tails")
        # numbered as they arrive, then dealt out: a batch may lie in fewer pieces than there are cores
        arrived = batch.withColumns({"log": F.col("source"), "arrival": F.monotonically_increasing_id()})
        parse_logs(spread(arrived), as_of=as_of).write.mode("overwrite").parquet(part)
        entries = spark.read.parquet(part).withColumn("_new", F.lit(True))
        before = tails.before(spark, batch_id)
        if before is None:
            before = entries.drop("_new").limit(0)
        entries = before.withColumn("_new", F.lit(False)).unionByName(entries)
        errors = with_context(
            entries, F.col("is_error") & F.col("_new"), half, order="arrival", groups=["log"]
        ).drop("_new")
        diagnose(errors, context="context").write.mode("overwrite").parquet(
            f"{diagnoses_path}/batch_id={batch_id}"
        )
        # numbered below zero, ahead of the next batch
        last = last_rows(entries, half, "arrival", ["log"])
        newest = Window.partitionBy("log").orderBy(F.desc("arrival"))
        tails.write(
            last.withColumn("arrival", -F.row_number().over(newest).cast("bigint")), batch_id
        )

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()
