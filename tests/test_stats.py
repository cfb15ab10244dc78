import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.operators import anomaly, order, rates, stats
from loomlog.operators.order import last_rows, with_context, with_position


def test_percentiles_match_numpy(spark):
    rng = random.Random(7)
    values = [rng.choice([0.0, -3.5, 12.25]) for _ in range(40)]
    values += [rng.lognormvariate(3, 2) * rng.choice([-1, 1]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    asked = (0, 10, 50, 90, 99, 99.9, 100)
    found = {r.percent: r.value for r in stats.exact_percentiles(df, "v", asked).collect()}
    for p in asked:
        assert found[float(p)] == pytest.approx(np.percentile(values, p), rel=1e-12)


@pytest.mark.parametrize("values,percent,wanted", [
    ([1, 2, 3, 4], 50, 2.5), ([1, 2, 3, 4], 99.9, 3.997), ([7], 50, 7.0), ([], 50, 0.0),
    ([4, 1, 3, 2], 50, 2.5), ([1, 2, 3], -50, 1.0), ([1, 2, 3], 500, 3.0),
])
def test_percentile_cases(spark, values, percent, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    (row,) = stats.exact_percentiles(df, "v", [percent]).collect()
    assert row.value == pytest.approx(wanted)


@pytest.fixture(scope="module")
def skewed(spark):
    """One source holds most rows; line numbers have gaps."""
    rng = random.Random(3)
    rows, line = [], 0
    for _ in range(900):
        line += rng.choice([1, 1, 1, 2, 40])
        source = rng.choice(["hot"] * 8 + ["a", "b"])
        rows.append((source, line, f"line {line}", rng.random() < 0.05))
    return rows, spark.createDataFrame(
        rows, "source string, line_number bigint, raw string, is_error boolean"
    )


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_tail_position_and_context_over_a_hot_source(skewed, width):
    rows, df = skewed
    by_source = {s: [r for r in rows if r[0] == s] for s in ("hot", "a", "b")}
    for n in (1, 13, 2000):
        found = last_rows(df, n, groups=["source"], width=width).collect()
        wanted = {r for s in by_source.values() for r in s[-n:]}
        assert {tuple(r) for r in found} == wanted
    placed = with_position(df, width=width).collect()
    wanted = {(s, r[1]): i for s, part in by_source.items() for i, r in enumerate(part)}
    assert {(r.source, r.line_number): r.position for r in placed} == wanted
    near = with_context(df, F.col("is_error"), half=3, width=width).collect()
    for row in near:
        at = wanted[(row.source, row.line_number)]
        part = by_source[row.source]
        assert row.context == [r[2] for r in part[max(0, at - 3): at + 4]]
    assert len(near) == sum(r[3] for r in rows)


def test_last_rows_without_groups_beyond_the_limit(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr("loomlog.operators.order.ORDERED_LIMIT", 5)
    found = last_rows(df, 100, width=50).collect()
    assert {r.line_number for r in found} == {r[1] for r in rows[-100:]}


def _seconds(seed, length, keys=("x",)):
    rng = random.Random(seed)
    rows = []
    for key in keys:
        sec = 1000 + rng.randrange(50)
        for _ in range(length):
            sec += rng.choice([1, 1, 1, 2, 9, 120])
            burst = rng.random() < 0.1
            rows.append((key, sec, 5, rng.choice([0, 0, 1, 30 if burst else 0])))
    return rows


def brute_ticks(rows):
    """The rule, tick by tick."""
    seconds = sorted((s, e) for _, s, _, e in rows)
    start, end = seconds[0][0], seconds[-1][0]
    baseline, tick, out = 0.5, start + 5, []
    while tick <= end:
        window = [(s, e) for s, e in seconds if tick - 60 < s <= tick and e > 0]
        total = sum(e for s, e in seconds if s <= tick)
        span = max(1, min(tick - window[0][0] + 1, 60)) if window else 1
        rate = sum(e for _, e in window) / span * 60
        out.append((tick, rate, total, baseline, rate >= 5 and total >= 10 and rate / baseline >= 3))
        baseline = anomaly.KEEP * baseline + (1 - anomaly.KEEP) * max(rate, 1.0)
        tick += 5
    return out


@pytest.mark.parametrize("chunk", [12, 60, 2000])
def test_spike_ticks_match_the_recursion(spark, chunk):
    rows = _seconds(11, 300, ("x", "y"))
    df = spark.createDataFrame(rows, "key string, sec bigint, n int, err int")
    found = anomaly.spike_ticks(df, keys=["key"], chunk_ticks=chunk).orderBy("key", "tick").collect()
    for key in ("x", "y"):
        wanted = [w for w in brute_ticks([r for r in rows if r[0] == key]) if w[1] > 0]
        got = [r for r in found if r.key == key]
        assert [(r.tick, r.total_errors, r.is_spike) for r in got] == [
            (w[0], w[2], w[4]) for w in wanted
        ]
        assert [r.errors_per_min for r in got] == pytest.approx([w[1] for w in wanted], rel=1e-12)
        assert [r.baseline for r in got] == pytest.approx([w[3] for w in wanted], rel=1e-10)
    assert any(r.is_spike for r in found)


def test_ticks_grow_with_the_errors_not_the_clock(spark):
    rows = [("x", 0, 1, 1), ("x", 365 * 86_400, 1, 1)]
    df = spark.createDataFrame(rows, "key string, sec bigint, n int, err int")
    found = anomaly.spike_ticks(df, keys=["key"]).orderBy("tick").collect()
    assert len(found) == 12 and found[-1].tick == 365 * 86_400
    assert found[-1].baseline == pytest.approx(1.0)


def test_narrow_values_are_spread_over_ranges(spark):
    df = spark.range(5000).selectExpr("1704067200 + id AS v")
    found = {r.percent: r.value for r in stats.exact_percentiles(df, "v", [0, 37.5, 99]).collect()}
    assert found == pytest.approx({p: 1704067200 + 4999 * p / 100 for p in (0.0, 37.5, 99.0)}, abs=1e-6)


def test_last_rows_over_several_files(spark, monkeypatch):
    rows = [(f, n, n == 2) for f, size in (("a.log", 500), ("b.log", 3)) for n in range(1, size + 1)]
    df = spark.createDataFrame(rows, "source string, line_number bigint, is_error boolean")
    for limit in (10_000, 1):
        monkeypatch.setattr("loomlog.operators.order.ORDERED_LIMIT", limit)
        found = {(r.source, r.line_number) for r in stats.recent_rows(df, 4).collect()}
        assert found == {("a.log", 500), ("b.log", 1), ("b.log", 2), ("b.log", 3)}
    assert stats.latest_error(df).first().source == "b.log"
    assert stats.latest_error(df, within=1).collect() == []


def test_windows_must_fit_their_chunk(spark):
    df = spark.createDataFrame([("x", 1, 1, 1)], "key string, sec bigint, n int, err int")
    with pytest.raises(ValueError):
        rates.rolling_rates(df, stretch=299)


@pytest.mark.parametrize("stretch", [300, 3600])
def test_rolling_rates_across_stretches(spark, stretch):
    rows = _seconds(5, 400)
    df = spark.createDataFrame(rows, "key string, sec bigint, n int, err int")
    found = rates.rolling_rates(df, stretch=stretch).orderBy("sec").collect()
    assert len(found) == len(rows)
    for row in found:
        minute = [r for r in rows if row.sec - 60 < r[1] <= row.sec]
        five = [r for r in rows if row.sec - 300 < r[1] <= row.sec]
        assert row.lines_60s == sum(r[2] for r in minute)
        assert row.errors_300s == sum(r[3] for r in five)
        span = max(1, min(row.sec - min(r[1] for r in minute) + 1, 60))
        assert row.lines_per_sec == pytest.approx(row.lines_60s / span)


def test_sparkline_cases(spark):
    cases = [
        ([], ""), ([5, 5, 5], "▃▃▃"), ([0, 0], "  "), ([0, 1, 2, 3, 4, 5, 6, 7, 8], " ▁▂▃▄▅▆▇█"),
        (list(range(100)), None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, v array<int>")
    found = df.select("i", rates.sparkline(F.col("v"), 20).alias("s")).orderBy("i").collect()
    for row, (_, wanted) in zip(found, cases):
        assert row.s == wanted if wanted is not None else len(row.s) == 20


def test_quiet_and_missing_clock(spark):
    quiet = spark.createDataFrame([(1000, 5, 0), (1010, 5, 0)], "sec bigint, n int, err int")
    (row,) = rates.current_rates(quiet).collect()
    assert (row.lines_per_sec, row.errors_per_sec) == (pytest.approx(10 / 11), 0.0)
    (row,) = rates.current_rates(quiet, as_of=5000).collect()
    assert (row.lines_per_sec, row.errors_per_sec) == (0.0, 0.0)
    assert [r.n for r in rates.last_series(quiet, as_of=5000).collect()] == [0] * 60


def test_empty_input(spark):
    empty = spark.createDataFrame(
        [], "level_name string, source string, line_number bigint, is_error boolean, "
            "fingerprint string, ts_epoch double, timestamp string"
    )
    (row,) = stats.totals(empty).collect()
    assert (row.total_lines, row.error_ratio) == (0, 0.0)
    (row,) = stats.seen_window(empty).collect()
    assert (row.first_seen, row.last_seen) == ("N/A", "N/A")
    (row,) = stats.snapshot(empty).collect()
    assert row.total_lines == 0 and row.level_counts == {}


def _walked(errors, start, until):
    """Baseline before and after a moment, tick by tick."""
    def rate(at):
        inside = {s: e for s, e in errors.items() if at - 60 < s <= at}
        return sum(inside.values()) / max(1, min(at - min(inside) + 1, 60)) * 60 if inside else 0.0

    baseline, tick = anomaly.BASELINE_START, start + 5
    while tick < until:
        baseline = anomaly.KEEP * baseline + (1 - anomaly.KEEP) * max(rate(tick), 1.0)
        tick += 5
    after = baseline
    if tick == until:
        after = anomaly.KEEP * baseline + (1 - anomaly.KEEP) * max(rate(tick), 1.0)
    return rate(until), baseline, after


@pytest.mark.parametrize("until", [0, 3, 5, 61, 305, 1899, 1900, 1903])
def test_snapshot_judges_like_the_ticks(spark, until):
    errors = {1000 + s: 1 + s % 7 * (s // 600) for s in range(0, until + 1, 1 + until // 150)}
    rows = [(s, True, k) for s, n in errors.items() for k in range(n)] + [(1000 + until, False, 0)]
    entries = spark.createDataFrame(
        [(float(s), "ERROR" if e else "INFO", e, f"sig{k % 3}" if e else "", f"h{s % 14}", i)
         for i, (s, e, k) in enumerate(rows)],
        "ts_epoch double, level_name string, is_error boolean, fingerprint string, source string, "
        "line_number long",
    )
    (row,) = stats.snapshot(entries, dropped=7).collect()
    rate, before, after = _walked(errors, 1000, 1000 + until)
    assert row.error_rate_per_min == pytest.approx(rate)
    assert row.baseline_rate == pytest.approx(after)
    assert row.spike_ratio == pytest.approx(rate / before)
    assert row.spike_active == (rate >= 5 and sum(errors.values()) >= 10 and rate / before >= 3)
    assert len(row.sparkline) == 60 and row.dropped_lines == 7
    assert row.unique_errors == len({k % 3 for _, e, k in rows if e})
    if until and until % 5 == 0:
        (tick,) = anomaly.spike_ticks(rates.per_second(entries)).filter(f"tick = {1000 + until}").collect()
        assert (tick.baseline, tick.next_baseline) == pytest.approx((before, after))


def test_snapshot_lists_are_cut_in_shares(spark, monkeypatch):
    """Ranks within shares change nothing: more names and seconds than any share keeps."""
    monkeypatch.setattr(anomaly, "REACH", 20)
    entries = spark.range(4000).selectExpr(
        "cast(1000 + id div 4 as double) ts_epoch", "'ERROR' level_name", "true is_error",
        "concat('sig', cast(sqrt(id) as int)) fingerprint", "concat('s', id % 97 % 60) source",
        "id line_number",
    )
    (row,) = stats.snapshot(entries).collect()
    counts = {}
    for k in range(4000):
        counts.setdefault(f"sig{math.isqrt(k)}", []).append(k)
    best = sorted(counts, key=lambda c: (-len(counts[c]), counts[c][0]))[:12]
    assert [(p.name, p.cnt) for p in row.top_signatures] == [(c, len(counts[c])) for c in best]
    assert row.unique_errors == len(counts) and row.total_lines == 4000
    assert row.errors_last_minute == 240 and len(row.source_counts) == 10


@pytest.mark.parametrize("half,width", [(6, 16), (2, 1024), (3, 4)])
def test_context_islands_and_fallback(spark, half, width):
    """Dense, sparse, missing and edge targets; logs without a target give their tail."""
    rng = random.Random(half)
    logs = {
        "dense": [True] * 50, "none": [False] * 40, "short": [False] * 5, "edges": [True] + [False] * 70 + [True],
        "mixed": [rng.random() < 0.1 for _ in range(300)], None: [k % 17 == 3 for k in range(60)],
    }
    rows = [(g, 3 * k, f"{g} {k}", None if g == "short" else t) for g, hits in logs.items() for k, t in enumerate(hits)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, line_number bigint, raw string, hit boolean")
    wanted = {}
    for g, hits in logs.items():
        texts = [f"{g} {k}" for k in range(len(hits))]
        for k, hit in enumerate(hits):
            if hit:
                wanted[g, 3 * k] = texts[max(0, k - half): k + half + 1]
        if not any(hits):
            wanted[g, 3 * (len(hits) - 1)] = texts[-2 * half:]
    near = with_context(df, F.col("hit"), half, width=width)
    assert near.columns == ["source", "line_number", "raw", "hit", "context"]
    found = {(r.source, r.line_number): r.context for r in near.collect()}
    assert found == {k: v for k, v in wanted.items() if k[0] not in ("none", "short")}
    whole = order.context_or_tail(df, F.col("hit"), half).collect()
    assert {(r.source, r.line_number): r.context for r in whole} == wanted and len(whole) == len(wanted)


def test_context_of_nothing(spark):
    empty = spark.createDataFrame([], "source string, line_number bigint, raw string, hit boolean")
    assert order.context_or_tail(empty, F.col("hit"), 6).collect() == []


@pytest.mark.parametrize("shape", ["even", "long tail", "few values", "in order"])
def test_sketches_are_near_the_exact_percentiles(spark, shape):
    """Merged sketches of forty days: every rank is within 1.5 % of the exact one."""
    rng = random.Random(11)
    draw = {
        "even": rng.random, "long tail": lambda: rng.lognormvariate(0, 4),
        "few values": lambda: float(rng.randrange(5)), "in order": iter(range(100_000)).__next__,
    }[shape]
    values = [float(draw()) for _ in range(20_000)]
    df = spark.createDataFrame(
        [(k // 500, v) for k, v in enumerate(values)] + [(3, None), (4, float("nan")), (99, None)],
        "day int, v double",
    )
    days = stats.quantile_sketches(df, "v", ["day"])
    merged = stats.merge_sketches(days)
    assert merged.collect()[0].n == 20_000 and days.filter("n = 0").count() == 1
    # a sketch does not grow with the values
    assert merged.select(F.length("sketch")).first()[0] < 20_000
    exact = {r.percent: r.value for r in stats.exact_percentiles(
        df.filter("not isnan(v)"), "v", (0, 5, 50, 95, 100)).collect()}
    ordered = np.sort(values)
    for row in stats.sketch_percentiles(merged, (0, 5, 50, 95, 100)).collect():
        low, high = np.searchsorted(ordered, row.value, "left"), np.searchsorted(ordered, row.value, "right")
        at = np.searchsorted(ordered, exact[row.percent])
        wanted = row.percent / 100 * 20_000
        assert low - 300 <= wanted <= high + 300 and abs(wanted - at) <= 20_000
        if row.percent in (0, 100):
            assert row.value == exact[row.percent]
