import collections
import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomlog.operators import anomaly, stats
from loomlog.operators.parse import parse_logs
from loomlog.plans import live as plans
from loomlog.plans.files import landed_lines
from loomlog.streaming import live, tables


def _land(folder, name, lines):
    with open(folder / name, "w") as out:
        out.write("".join(line + "\n" for line in lines))


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _land(folder, "s1.log", ["ERROR one", "", "INFO two"])

    def run():
        entries = parse_logs(live.read_live(spark, str(folder)), columns=["raw", "level_name", "source"])
        live.start_table(entries, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        return sorted(r.raw for r in spark.read.parquet(str(tmp_path / "t")).collect())

    assert run() == ["ERROR one", "INFO two"]
    _land(folder, "s2.log", ["WARN three"])
    assert run() == ["ERROR one", "INFO two", "WARN three"]
    assert run() == ["ERROR one", "INFO two", "WARN three"]


def test_start_at_skips_older_segments(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _land(folder, "old.log", ["old"])
    past = time.time() - 86_400
    os.utime(folder / "old.log", (past, past))
    _land(folder, "new.log", ["new"])
    since = datetime.datetime.fromtimestamp(past + 3600, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    lines = live.read_live(spark, str(folder), start_at=since)
    live.start_table(lines, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [r.raw for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["new"]


def test_late_lines_are_counted(spark, tmp_path):
    schema = "event_time timestamp, is_error boolean"
    folder = str(tmp_path / "in")

    def add(*seconds):
        rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), False) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    add(0, 1, 2, 100)
    stream = spark.readStream.schema(schema).parquet(folder)
    counts = live.flat_seconds(live.second_counts(stream, "10 seconds"))
    late = live.LateRows()
    spark.streams.addListener(late)
    query = live.start_table(counts, str(tmp_path / "t"), str(tmp_path / "c"), once=False)
    try:
        query.processAllAvailable()
        add(95, 3)  # 95 is within the delay of 100, 3 is not
        query.processAllAvailable()
        add(300)
        query.processAllAvailable()
        for _ in range(100):  # reports come on a thread of their own
            if late.of(query):
                break
            time.sleep(0.1)
        assert late.of(query) == 1
    finally:
        query.stop()
        spark.streams.removeListener(late)
    found = sorted((r.sec - 1704067200, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert found == [(0, 1), (1, 1), (2, 1), (95, 1), (100, 1)]


def test_live_spikes_equal_the_batch_ticks_over_many_batches(spark, tmp_path):
    rows = [("k", 1000 + i * 3, 1, 40 if 60 < i < 70 else i % 11 == 0) for i in range(150)]
    rows = [(k, s, n, int(e)) for k, s, n, e in rows]
    schema = "source string, sec bigint, n bigint, err bigint"
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    for i in range(0, 150, 37):
        spark.createDataFrame(rows[i:i + 37], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live.start_table(
        live.live_spikes(stream), str(tmp_path / "t"), str(tmp_path / "c")
    ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "t")).orderBy("tick").collect()
    wanted = anomaly.spike_ticks(df).orderBy("tick").collect()
    assert [(r.tick, r.total_errors, r.is_spike) for r in found] == [
        (r.tick, r.total_errors, r.is_spike) for r in wanted]
    assert [r.next_baseline for r in found] == pytest.approx([r.next_baseline for r in wanted])
    assert any(r.is_spike for r in found)


def test_live_spikes_on_a_clock_of_days(spark, tmp_path):
    """The weights of a batch's first and last tick may lie beyond all numbers apart."""
    sections = [0, 9_000, 30_000, 200_000]
    rows = [("k", 1000 + s + 5 * i, 1, 3 + (i > 20) * 40) for s in sections for i in range(40)]
    schema = "source string, sec bigint, n bigint, err bigint"
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    live.start_table(live.live_spikes(stream), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "t")).orderBy("tick").collect()
    wanted = anomaly.spike_ticks(df).orderBy("tick").collect()
    assert [(r.tick, r.total_errors, r.is_spike) for r in found] == [
        (r.tick, r.total_errors, r.is_spike) for r in wanted]
    assert [r.baseline for r in found] == pytest.approx([r.baseline for r in wanted])
    assert [r.next_baseline for r in found] == pytest.approx([r.next_baseline for r in wanted])


def test_lines_without_a_time_count_at_their_arrival(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at, True, at), (None, True, at + datetime.timedelta(seconds=1)), (None, False, at),
            (at + datetime.timedelta(seconds=60), False, at)]
    schema = "event_time timestamp, is_error boolean, arrival timestamp"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    counts = live.second_counts(spark.readStream.schema(schema).parquet(folder), "5 seconds")
    flat = counts.select(F.unix_timestamp("window.start").alias("sec"), "n", "err", "filled")
    live.start_table(flat, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert found == [(1704067200, 2, 1, 1), (1704067201, 1, 1, 1)]


def test_context_reaches_into_earlier_batches(spark, tmp_path):
    schema = "raw string, source string, line_number bigint"
    folder = str(tmp_path / "in")
    lines = [f"INFO step {k} of the job" for k in range(9)] + ["ERROR disk is full: no space left"]
    lines[4] = '{"level": "info", "source": "another", "msg": "a line with a source of its own"}'
    for part in (lines[:3], lines[3:9], lines[9:]):
        rows = [(text, "job.log", 0) for text in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # segments are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    live.start_diagnosis(
        stream, str(tmp_path / "e"), str(tmp_path / "d"), str(tmp_path / "c"), half=8
    ).awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "d")).collect()
    assert row.related_entries == lines[1:]


def _segments(folder, logs):
    """Segments of several logs, landed one after the other: ``(log, lines)``."""
    for log, lines in logs:
        (folder / log).mkdir(parents=True, exist_ok=True)
        k = len(list(folder.glob("*/*")))
        _land(folder / log, f"{k}.txt", lines)
        os.utime(folder / log / f"{k}.txt", (1.7e9 + k, 1.7e9 + k))


def _log_of():
    return F.element_at(F.split("source", "/"), -2)


@pytest.mark.parametrize("count_blank", [False, True])
def test_line_numbers_go_on_over_batches(spark, tmp_path, count_blank):
    """Three batches of two logs are numbered like one reading of both, also after a restart."""
    rng = random.Random(4)
    parts = [
        (f"log{k % 2}", [f"line {k} {i}" if rng.random() < 0.8 else " " for i in range(rng.randrange(1, 40))])
        for k in range(6)
    ]
    wanted = {"log0": [], "log1": []}
    for log, lines in parts:
        wanted[log] += lines
    wanted = {
        (log, text): number
        for log, lines in wanted.items()
        for number, text in enumerate([t for t in lines if count_blank or t.strip()], 1)
        if text.strip()
    }
    folder, path = tmp_path / "in", str(tmp_path / "t")
    for some in (parts[:3], parts[3:]):  # a restart lies between
        _segments(folder, some)
        lines = live.read_live(spark, str(folder), files_per_trigger=2, log=_log_of())
        tables.start_numbered(
            lines, path, str(tmp_path / "c"), count_blank=count_blank
        ).awaitTermination()
    rows = spark.read.parquet(path).collect()
    assert {(r.log, r.raw): r.line_number for r in rows} == wanted and len(rows) == len(wanted)
    # two versions of the counts are kept, whatever the number of batches
    assert len(tables.Versions(f"{path}_lines").whole(spark)) == 2


def test_a_missing_version_is_an_error(spark, tmp_path):
    held = tables.Versions(str(tmp_path / "v"))
    assert held.before(spark, 0) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        held.before(spark, 3)
    for k in range(5):
        held.write(spark.range(k + 1), k)
    assert held.whole(spark) == [3, 4] and held.newest(spark).count() == 5
    # a batch that runs again finds what the one before it left
    assert held.before(spark, 4).count() == 4


def test_totals_are_compacted(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    for k in range(5):
        rows = [(f"n{i % (k + 1)}",) for i in range(10)]
        spark.createDataFrame(rows, "source string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("source string").option("maxFilesPerTrigger", 1).parquet(folder)
    tables.start_totals(stream, ["source"], path, str(tmp_path / "c")).awaitTermination()
    found = {r.source: r.cnt for r in tables.Versions(path).newest(spark).collect()}
    wanted = collections.Counter(f"n{i % (k + 1)}" for k in range(5) for i in range(10))
    assert found == wanted and len(tables.Versions(path).whole(spark)) == 2


def _closed_by_hand(batches, delay):
    """Closed seconds and lost lines, batch by batch."""
    open_, closed, lost, mark = collections.Counter(), {}, collections.Counter(), None
    for rows in batches:
        for key, sec in rows:
            if mark is not None and sec + 1 <= mark:
                lost[key] += 1
            else:
                open_[key, sec] += 1
        seen = [sec for _, sec in open_]
        mark = max([m for m in (mark, max(seen) - delay if seen else None) if m is not None])
        for at in [at for at in open_ if at[1] + 1 <= mark]:
            closed[at] = open_.pop(at)
    return closed, dict(lost)


@pytest.mark.parametrize("stops", [(5,), (1, 3, 5), (2, 2, 4, 5)])
def test_lost_lines_outlast_restarts(spark, tmp_path, stops):
    """The account of lost lines is the same, however often the query is started anew."""
    rng = random.Random(9)
    batches = [
        [(f"k{rng.randrange(3)}", 100 * b + rng.randrange(-90, 100)) for _ in range(60)] for b in range(5)
    ]
    schema = "event_time timestamp, is_error boolean, grp string"
    folder, path, done = str(tmp_path / "in"), str(tmp_path / "t"), 0
    for stop in stops:
        for rows in batches[done:stop]:
            full = [(datetime.datetime.fromtimestamp(5000 + s, datetime.UTC), False, k) for k, s in rows]
            spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(folder)
            time.sleep(0.02)
        done = stop
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        tables.start_seconds(
            stream, path, str(tmp_path / "c"), delay=30, keys=["grp"]
        ).awaitTermination()
    closed, lost = _closed_by_hand(batches, 30)
    found = tables.closed_seconds(spark, path).collect()
    assert {(r.grp, r.sec - 5000): r.n for r in found} == closed and len(found) == len(closed)
    assert {r.grp: r.lost for r in tables.lost_lines(spark, path).collect()} == lost and sum(lost.values())
    empty = spark.createDataFrame([], "level_name string, source string, line_number bigint, "
                                  "is_error boolean, fingerprint string, ts_epoch double")
    (row,) = stats.snapshot(empty, dropped=tables.lost_total(spark, path)).collect()
    assert row.dropped_lines == sum(lost.values())


def test_idle_keys_leave_the_state(spark, tmp_path):
    """A key that comes back after the idle time is a new one; the others are not touched."""
    early = [("gone", 1000 + s, 1, 1) for s in range(0, 30, 3)]
    always = [("here", 1000 + s, 1, int(s % 40 < 4)) for s in range(0, 4000, 2)]
    again = [("gone", 4900 + s, 1, 1) for s in range(0, 30, 3)]
    schema = "source string, sec bigint, n bigint, err bigint"
    folder = str(tmp_path / "in")
    for rows in (early + always[:500], always[500:1500], always[1500:], again):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint = str(tmp_path / "c")
    live.start_table(live.live_spikes(stream, idle=600), str(tmp_path / "t"), checkpoint).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "t")).orderBy("source", "tick").collect()
    wanted = []
    for rows in (early, again, always):
        wanted += anomaly.spike_ticks(spark.createDataFrame(rows, schema), ["source"]).orderBy("tick").collect()
    assert [(r.source, r.tick, r.total_errors, r.is_spike) for r in found] == [
        (r.source, r.tick, r.total_errors, r.is_spike) for r in wanted]
    assert [r.baseline for r in found] == pytest.approx([r.baseline for r in wanted])
    clock = spark.read.format("statestore").option("stateVarName", "clock").load(checkpoint)
    # the first stay of the key has left; what is there is its second one
    assert {r.key.source: r.value.start for r in clock.collect()} == {"here": 1000, "gone": 4900}


def test_landed_segments_are_read_in_few_batches(spark, small, monkeypatch):
    asked = []
    read = live.read_live
    monkeypatch.setattr(plans, "landed_lines", lambda spark, sf_dir: landed_lines(spark, sf_dir, 10))
    monkeypatch.setattr(
        live, "read_live", lambda *a, files_per_trigger, **k: asked.append(files_per_trigger) or
        read(*a, files_per_trigger=files_per_trigger, **k))
    segments = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id div 10 AS s").distinct().count()
    found = plans.live_files(spark, small)
    assert segments > 2 * plans.BATCHES >= 2 * -(-segments // asked[0])
    assert found.agg(F.sum("cnt")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_a_batch_in_one_piece_is_parsed_by_many_tasks(spark, tmp_path):
    rows = [(f"INFO step {k} of the job" if k % 50 else "ERROR disk is full", "job.log", 0) for k in range(400)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "raw string, source string, line_number bigint").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("raw string, source string, line_number bigint").parquet(folder)
    live.start_diagnosis(
        stream, str(tmp_path / "e"), str(tmp_path / "d"), str(tmp_path / "c"), half=2
    ).awaitTermination()
    entries = spark.read.parquet(str(tmp_path / "e"))
    assert [r.raw for r in entries.orderBy("arrival").collect()] == [r[0] for r in rows]
    assert len(entries.inputFiles()) > 1
    related = {tuple(r.related_entries) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert ("INFO step 48 of the job", "INFO step 49 of the job", "ERROR disk is full",
            "INFO step 51 of the job", "INFO step 52 of the job") in related
