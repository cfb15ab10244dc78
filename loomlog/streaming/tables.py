"""Results and state that survive batches, as versioned tables.

What a stream must remember between batches is a small table with one version per batch. A
batch reads the version of the batch before it and writes its own; a batch that is run again
after a failure does the same again and replaces what it wrote. Two versions are kept, the last
whole one for readers and repeated batches, so storage does not grow with the number of batches.
No count lives in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlog.sinks.versions import Versions
from loomlog.sources.textlogs import drop_blank


def _start(
    stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], once: bool
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


# -- running totals (T3) ---------------------------------------------------------------------


def start_totals(
    entries: DataFrame, by: Sequence[str], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Totals so far by level, source or signature; read them with ``Versions.newest``.

    A batch is counted on its own and added to the totals before it, so its cost grows with
    the batch and the number of names, not with what was counted before.
    """
    table = Versions(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*by).agg(F.count("*").alias("cnt"))
        before = table.before(batch.sparkSession, batch_id)
        if before is not None:
            counts = before.unionByName(counts).groupBy(*by).agg(F.sum("cnt").alias("cnt"))
        table.write(counts, batch_id)

    return _start(entries, checkpoint, run, once)


# -- line numbers of live logs (T1) ------------------------------------------------------------


def number_lines(
    batch: DataFrame,
    batch_id: int,
    state: str,
    log: str = "log",
    count_blank: bool = False,
    order: Sequence[str] = ("arrival", "source", "block"),
) -> DataFrame:
    """The lines of a batch with numbers that go on from the batches before it.

    For use in ``foreachBatch`` on ``live.read_live(..., log=...)``. Segments of one log that
    came in one batch follow each other by ``order``. A first pass counts the lines of every file
    split; a line's number is its log's lines in earlier batches, those of earlier splits, and
    its place in its own split. Lines are neither sorted nor shuffled, however long a log is.
    Blank lines are dropped; they count where ``count_blank`` says so.
    """
    spark = batch.sparkSession
    table = Versions(state)
    lines = batch if count_blank else drop_blank(batch)
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    earlier = Window.partitionBy(log).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy(log, "arrival", "source", "block")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_ahead", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    before = table.before(spark, batch_id)
    if before is None:
        before = spark.createDataFrame([], f"{log} string, lines bigint")
    splits = (
        splits.join(before, splits[log].eqNullSafe(before[log]), "left")
        .drop(before[log])
        .withColumn("_start", F.col("_ahead") + F.coalesce("lines", F.lit(0)) - F.col("_first") + 1)
    )
    ended = splits.groupBy(log).agg(F.sum("_rows").alias("lines"))
    table.write(before.unionByName(ended).groupBy(log).agg(F.sum("lines").alias("lines")), batch_id)

    # one row per split, read from a file: Spark sends it to every task if it is small enough
    splits.select("source", "block", "_start").write.mode("overwrite").parquet(f"{state}_splits")
    starts = spark.read.parquet(f"{state}_splits")
    numbered = lines.join(starts, ["source", "block"], "left").withColumn(
        "line_number", F.col("_id") + F.col("_start")
    )
    return drop_blank(numbered).drop("_id", "_start", "block")


def start_numbered(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    then: Callable[[DataFrame], DataFrame] = lambda lines: lines,
    once: bool = True,
    **numbering,
) -> StreamingQuery:
    """Land numbered lines in a table, after ``then`` has made what it will of them.

    Each batch writes its own folder of the table, so a repeated batch replaces itself.
    ``numbering`` goes to ``number_lines``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        numbered = number_lines(batch, batch_id, f"{path}_lines", **numbering)
        then(numbered).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(lines, checkpoint, run, once)


# -- closed seconds and what came too late (T4, T6, T7) -----------------------------------------


def start_seconds(
    entries: DataFrame,
    path: str,
    checkpoint: str,
    delay: int = 600,
    keys: Sequence[str] = (),
    once: bool = True,
) -> StreamingQuery:
    """Closed seconds ``(keys, sec, n, err, filled)``, and an account of lost lines.

    A second is closed when the newest line of the batches up to now is ``delay`` seconds past
    its end; only then it is written, once. A line of a second that was closed before its batch
    is late: it is counted as lost, by key, and left out. Open seconds and lost lines are versioned tables
    beside the result, so they outlast a restart and every line is in exactly one of the three.
    A line without a time counts at its ``arrival`` or else when its batch runs (``filled``).
    """
    open_seconds, lost = Versions(f"{path}_open"), Versions(f"{path}_lost")
    arrival = F.col("arrival") if "arrival" in entries.columns else F.current_timestamp()
    sums = [F.sum(c).alias(c) for c in ("n", "err", "filled")]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        when = F.coalesce(F.col("event_time").cast("timestamp"), arrival)
        counted = (
            batch.withColumns({"sec": F.unix_timestamp(when), "_filled": F.col("event_time").isNull()})
            .groupBy(*keys, "sec")
            .agg(
                F.count("*").alias("n"), F.count_if("is_error").alias("err"),
                F.count_if("_filled").alias("filled"),
            )
        )
        held = open_seconds.before(spark, batch_id)
        none = F.lit(None).cast("bigint")
        reached = none if held is None else held.agg(F.max("closed")).scalar()
        judged = counted.withColumn("_late", F.coalesce(F.col("sec") + 1 <= reached, F.lit(False)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*keys).schema)
        lost_before = lost.before(spark, batch_id)
        if lost_before is None:
            lost_before = spark.createDataFrame([], f"{kinds}{', ' if kinds else ''}lost bigint")
        lost_now = judged.filter("_late").select(*keys, F.col("n").alias("lost"))
        lost.write(
            lost_before.unionByName(lost_now).groupBy(*keys).agg(F.sum("lost").alias("lost")), batch_id
        )
        standing = judged.filter(~F.col("_late")).select(*keys, "sec", "n", "err", "filled")
        if held is not None:
            # a row without counts carries the moment itself
            standing = standing.unionByName(held.filter("sec is not null").drop("closed"))
        standing = standing.groupBy(*keys, "sec").agg(*sums)
        # written before it is split, so that the batch is read once for both sides
        merged = f"{path}_open/merged"
        standing.write.mode("overwrite").parquet(merged)
        standing = spark.read.parquet(merged)
        newest = F.greatest(reached, standing.agg(F.max("sec")).scalar() - delay)
        closed = F.coalesce(F.col("sec") + 1 <= newest, F.lit(False))
        standing.filter(closed).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        mark = spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in standing.schema]
        )
        open_seconds.write(
            standing.filter(~closed).unionByName(mark).withColumn("closed", newest), batch_id
        )

    return _start(entries, checkpoint, run, once)


def closed_seconds(spark: SparkSession, path: str) -> DataFrame:
    """The seconds that ``start_seconds`` has closed."""
    return spark.read.parquet(path).drop("batch_id")


def lost_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that came too late, by key, over all batches and restarts."""
    return Versions(f"{path}_lost").newest(spark)


def lost_total(spark: SparkSession, path: str) -> Column:
    """All lost lines, as the snapshot takes them (``dropped``)."""
    return F.coalesce(lost_lines(spark, path).agg(F.sum("lost")).scalar(), F.lit(0))
