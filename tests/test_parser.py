import pytest
from pyspark.sql import functions as F

from loomlog.functions.levels import level_name_sql, parse_level_sql
from loomlog.functions.timestamps import with_epoch
from loomlog.operators.classify import signature_table
from loomlog.operators.parse import analyze, entry_record, parse_logs

AS_OF = "2025-03-05 00:00:00"


@pytest.fixture(scope="module")
def parse(spark):
    def run(*lines, source="app.log", **options):
        df = spark.createDataFrame(
            [(line, source, i) for i, line in enumerate(lines)],
            "raw string, source string, line_number bigint",
        )
        as_of = F.lit(AS_OF).cast("timestamp")
        return parse_logs(df, as_of=as_of, **options).orderBy("line_number").collect()

    return run


def test_level_tokens(spark):
    tokens = {
        "INFO": "INFO", "info": "INFO", "  warn  ": "WARN", "WARNING": "WARN", "err": "ERROR",
        "crit": "CRITICAL", "panic": "FATAL", "emergency": "FATAL", "[fatal]": "FATAL",
        "nonsense": "INFO", "": "INFO",
    }
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    found = df.select("t", F.expr(level_name_sql(parse_level_sql("t"))).alias("l")).collect()
    assert {r.t: r.l for r in found} == tokens


# line -> expected values of some entry columns
FORMATS = [
    ("2025-03-04T05:06:07.250Z [ERROR] [cart] voucher rejected",
     dict(format="iso", level_name="ERROR", timestamp="2025-03-04T05:06:07.250Z",
          message="voucher rejected", source="cart", ts_epoch=1741064767.25)),
    ("2025-03-04 05:06:07 WARN queue depth 77",
     dict(format="iso", level_name="WARN", message="queue depth 77", ts_epoch=1741064767.0)),
    ('{"timestamp":"2025-03-04T05:06:07Z","level":"error","message":"stock-2 says connection refused",'
     '"host":"node-9"}',
     dict(format="json", level_name="ERROR", message="stock-2 says connection refused", source="node-9",
          fingerprint="conn_refused", meta={"host": "node-9"})),
    ('{"severity": 3, "message": "ledger is closed"}', dict(level_name="ERROR", message="ledger is closed")),
    ('{"msg":"all quiet"}', dict(level_name="INFO", message="all quiet", source="app.log")),
    ('{"level":"warn","level":"error","msg":"last wins"}',
     dict(format="json", level_name="ERROR", message="last wins")),
    ('{"ts":1700000000.5,"level":40,"msg":12.0,"process":{"id":7}}',
     dict(timestamp="1700000000.5", level_name="ERROR", message="12.0", pid="7", ts_epoch=0.0)),
    ('{"level": true, "msg": false}', dict(level_name="TRACE", message="False")),
    ('{"msg": "broken', dict(format="plain")),
    ("Mar  4 05:06:07 relay sshd[77]: Failed password for deploy",
     dict(format="syslog", level_name="ERROR", source="relay", fingerprint="auth_failure",
          message="Failed password for deploy", tag="sshd", pid="77", ts_epoch=1741064767.0)),
    ("Nov 11 11:11:11 relay backup: done", dict(ts_epoch=1731323471.0)),
    ('198.51.100.7 - ines [04/Mar/2025:05:06:07 +0000] "PUT /cart/items HTTP/1.1" 500 512 '
     '"-" "probe/1"',
     dict(format="access", level_name="ERROR", status_code=500, method="PUT", bytes=512,
          message="PUT /cart/items -> 500", fingerprint="http_5xx", source="app.log")),
    ('192.0.2.5 - - [04/Mar/2025:05:06:07 +0000] "GET /gone HTTP/1.1" 404 - "-" "probe/1"',
     dict(level_name="WARN", fingerprint="http_4xx", bytes=None)),
    ("[2025-03-04 05:06:07] [INFO] index rebuilt",
     dict(format="bracket", level_name="INFO", message="index rebuilt")),
    ("relay: [error] slot 9: write() gave up",
     dict(format="loose", level_name="ERROR", message="slot 9: write() gave up",
          timestamp="relay:")),
    ("an ordinary line of text",
     dict(format="plain", level_name="INFO", message="an ordinary line of text")),
    ("   ", dict(format="blank", raw="   ", message="", fingerprint="", level_name="INFO")),
    ("2025-03-04T05:06:07Z I am here", dict(level_name="INFO", message="am here")),
    ("2025-03-04T05:06:07Z [api] [worker] x", dict(source="api", message="[worker] x")),
    ("2025-03-04T05:06:07Z [ERROR] [WARN] x", dict(source="WARN", level_name="ERROR")),
    ("2025-03-04T05:06:07Z a b c - warn",
     dict(level_name="WARN", message="2025-03-04T05:06:07Z a b c - warn")),
]


def test_formats(parse):
    found = parse(*[line for line, _ in FORMATS])
    for row, (line, wanted) in zip(found, FORMATS):
        assert {k: row[k] for k in wanted} == wanted, line


@pytest.mark.parametrize("line", [
    "INFO [sql] plan took 512ms", "INFO [sql] plan took 404 ms",
    "INFO [load] 523 calls each second", "INFO [sync] moved 499 rows in 1234ms",
])
def test_plain_numbers_are_no_http_errors(parse, line):
    (row,) = parse(line)
    assert not row.is_error and not row.fingerprint.startswith("http_")


SIGNATURES = [
    ("CRITICAL worker 12 stopped: Out of memory", "oom"),
    ("ERROR spool 3: No space left on device", "disk_full"),
    ("ERROR cannot reach billing-2: connection refused", "conn_refused"),
    ("ERROR ledger: deadlock detected, victim session 4", "db_deadlock"),
    ("Traceback (most recent call last):", "python_traceback"),
    ("ERROR Permission denied while opening /srv/vault", "permission"),
    ("ERROR authentication failed for account 7", "auth_failure"),
    ("WARN slow query on table invoices, 2750ms", "slow_query"),
    ("ERROR peer 5: certificate verify failed", "certs"),
    ("ERROR circuit breaker OPEN towards stock-1", "dependency_down"),
    ("WARN edge 1 saw status 502 for /basket", "http_5xx"),
    ("ERROR tenant 8 is rate limited (429)", "throttle"),
    # gated: the words alone are not enough
    ("ERROR session 5: connection reset by peer", ""),
    ("ERROR accept: too many open files", ""),
    ("INFO heartbeat of node 4", "ok:INFO"),
]


def test_signatures(parse):
    found = parse(*[line for line, _ in SIGNATURES])
    assert [r.fingerprint for r in found] == [name for _, name in SIGNATURES]


def test_level_is_raised_and_duration_found(parse):
    oom, slow = parse(
        "INFO child 6 ended: Out of memory", "WARN slow query on invoices: 2750ms"
    )
    assert oom.level_name == "CRITICAL" and oom.is_error
    assert slow.duration_ms == 2750 and slow.meta["duration_ms"] == "2750"


def test_signature_table_order(spark):
    table = signature_table(spark).orderBy("sig_order").collect()
    assert len(table) == 18
    assert [r.name for r in table[:4]] == ["panic", "oom", "disk_full", "corruption"]
    severities = [r.severity for r in table]
    assert severities == sorted(severities, reverse=True)


def test_epochs(spark):
    stamps = {
        "2024-01-01T10:00:00Z": 1704103200.0,
        "2024-01-01T10:00:00.123456789+0530": 1704083400.123456,
        "2024-01-01 10:00:00,250": 1704103200.25,
        "2024-1-5 3:04:05": 1704423845.0,
        "2024-01-01": 1704067200.0,
        "20240101": 1704067200.0,
        "2024/01/02 03:04:05": 1704164645.0,
        "01/02/2024 03:04:05": 1704164645.0,
        "02/Jan/2024:03:04:05 +0100": 1704161045.0,
        "Feb 30 10:00:00": 0.0,
        "Foo 12 10:00:00": 0.0,
        "2024-13-01 00:00:00": 0.0,
        "1704103200": 0.0,
        "": 0.0,
    }
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    found = with_epoch(df, "s", "e", F.lit(AS_OF).cast("timestamp")).collect()
    assert {r.s: r.e for r in found} == stamps


def test_filters_are_not_pushed_into_the_parse(spark, small):
    lines = spark.createDataFrame([("ERROR x", "a", 1)], "raw string, source string, line_number bigint")
    plan = parse_logs(lines).filter("is_error").select("fingerprint")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Filter") < text.index("Generate inline")
    assert text.count("segmentation fault") == 1


def test_analysis_and_record(spark, parse):
    df = spark.createDataFrame([("ERROR boom", "a", 1)], "raw string, source string, line_number bigint")
    entries = parse_logs(df)
    (row,) = analyze(entries).collect()
    assert row.level_priority == 40 and row.is_error and row.error_categories == []
    (record,) = entry_record(entries).collect()
    assert record.level == "ERROR" and record.message == "boom"
