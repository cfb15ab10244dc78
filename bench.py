"""Wall time of the headline stages; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each stage runs once to warm up and then three times; the median counts. Parsing is then timed
once each on 8 and 80 times the lines, where planning and code generation no longer weigh.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from loomlog.operators import anomaly, rates, stats
from loomlog.operators.diagnose import diagnose, match_rules
from loomlog.operators.filters import apply_filters, build_spec
from loomlog.operators.order import with_context
from loomlog.operators.parse import parse_logs
from loomlog.plans.reports import _PLACE, _TALLY
from loomlog.session import local_session, shared_folder
from loomlog.sinks.export import text_line
from loomlog.sources.tables import as_of, dense_seconds, log_lines

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ROUNDS = 3


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, memory="12g", name="bench")
    scratch = shared_folder(spark)
    # the parse stage is timed from the table; later stages start from written entries
    entries_path = f"{scratch}/entries"
    parsed = parse_logs(log_lines(spark, SF_DIR), as_of=as_of())
    parsed.write.mode("overwrite").parquet(entries_path)
    entries = spark.read.parquet(entries_path)
    lines = entries.count()
    seconds = dense_seconds(spark, SF_DIR)
    spec = build_spec(min_level="ERROR", include="redis,refused")
    outputs = iter(range(1000))

    def write(fmt, df):
        getattr(df.write.mode("overwrite"), fmt)(f"{scratch}/out{next(outputs)}")

    stages = {
        "parse_all_fields": lambda: drain(parse_logs(log_lines(spark, SF_DIR), as_of=as_of())),
        "scan_top_signatures": lambda: drain(stats.top_signatures(
            parse_logs(log_lines(spark, SF_DIR), columns=_TALLY, as_of=as_of()), order=_PLACE)),
        "filter": lambda: drain(apply_filters(entries, spec)),
        "snapshot": lambda: drain(stats.snapshot(entries, order=_PLACE)),
        "percentiles": lambda: drain(
            stats.exact_percentiles(entries, "duration_ms", (50, 90, 99))),
        "rolling_rates": lambda: drain(rates.rolling_rates(seconds)),
        "spike_ticks": lambda: drain(anomaly.spike_ticks(seconds)),
        "rule_lookup": lambda: drain(match_rules(entries.filter("is_error"))),
        "diagnose_in_context": lambda: drain(diagnose(
            with_context(entries, entries.is_error, half=6), context="context")),
        "write_json": lambda: write("json", entries),
        "write_text": lambda: write("text", entries.select(text_line().alias("value"))),
    }
    times = {}
    for name, run in stages.items():
        run()
        taken = []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    large = {}
    for times_over in (8, 80):
        more = log_lines(spark, SF_DIR).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), F.lit(times_over)))
        ).drop("copy")
        start = time.perf_counter()
        drain(parse_logs(more.repartition(4 * CPUS), as_of=as_of()))
        large[str(lines * times_over)] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "log_pipeline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR).removeprefix("sf"), "lines": lines,
        "lines_per_sec_parse": round(lines / times["parse_all_fields"]), "cpus": CPUS,
        "parse_by_lines": large,
        "parse_core_usec_per_line": {
            n: round(CPUS * taken / int(n) * 1e6, 2) for n, taken in large.items()
        },
    }))
    spark.stop()


if __name__ == "__main__":
    main()
