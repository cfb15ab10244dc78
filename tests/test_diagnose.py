import pytest
from pyspark.sql import functions as F

from loomlog.fixed.rules import RULES
from loomlog.operators import diagnose as ops

MATCHES = [
    ("CRITICAL worker 12 stopped: Out of memory", "oom"),
    ("ERROR spool 3: No space left on device", "disk_full"),
    ("ERROR ledger: deadlock detected, victim session 4", "db_deadlock"),
    ("ERROR cannot reach billing-2: Connection refused", "conn_refused"),
    ("ERROR permission denied for /srv/vault", "permission"),
    ("ERROR authentication failed for account 7", "auth_failure"),
    ("ERROR peer 5: certificate verify failed", "tls"),
    ("WARN slow query on table invoices, 2750ms", "slow_query"),
    ("ERROR circuit breaker OPEN towards stock-1", "circuit_breaker"),
    ("ERROR accept: too many open files", "throttle"),
    ("error: got NXDOMAIN for mail-3", "dns"),
    ("panic: runtime error: slice bounds", "panic"),
    ("ERROR all 40 taken: connection pool exhausted", "db_deadlock"),
    ("edge 1 saw status 502", "http_5xx"),
    ("ERROR session 5: connection reset by peer", "conn_refused"),
    ("INFO heartbeat of node 4", None),
    ("an ordinary line of text", None),
]


@pytest.fixture(scope="module")
def lines(spark):
    def make(*texts):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")

    return make


def test_best_rules(lines):
    found = ops.best_rule(lines(*[t for t, _ in MATCHES])).orderBy("id").collect()
    assert [r.rule_id for r in found] == [rule for _, rule in MATCHES]


def test_every_rule_is_complete():
    assert len(RULES) == 19 and len({r.rule_id for r in RULES}) == 19
    assert all(r.checks and r.prevention for r in RULES)


def test_offline_diagnosis(lines):
    text = "ERROR deadlock detected after a slow query of 2750ms on invoices"
    rows = ops.diagnose(lines(text, "uvw opaque tokens 17 % of them here")).orderBy("id").collect()
    known, unknown = rows
    assert known.summary == "Database deadlock / lock contention"
    assert known.evidence[0] == "Matched rule 'db_deadlock' on: deadlock detected"
    assert known.recommendations[-1].title == "Also check: Capture the plan (Postgres)"
    assert known.recommendations[0].severity == "high" and known.severity == "high"
    assert known.recommendations[-1].severity == "medium"
    assert unknown.summary == "uvw opaque tokens 17 % of"
    assert unknown.confidence == "low" and len(unknown.recommendations) == 3
    assert unknown.evidence == ["Input: uvw opaque tokens 17 % of them here"]


def test_context_becomes_evidence(lines):
    context = F.array(
        F.lit("INFO opening the ledger"), F.lit("ERROR deadlock detected in shard 2"),
        F.lit("connection refused"), F.lit("x failed " + "y" * 300),
    )
    df = lines("ERROR Transaction failed").withColumn("ctx", context)
    (row,) = ops.diagnose(df, context="ctx").collect()
    assert row.evidence[1:] == [
        "ERROR deadlock detected in shard 2", ("x failed " + "y" * 300)[:180]
    ]
    assert row.related_entries[0] == "INFO opening the ledger"


def test_sizes_of_cuts_are_arguments(lines):
    context = F.array(*(F.lit(f"line {k} failed " + "y" * 300) for k in range(9)))
    df = lines("ERROR Transaction failed " + "z" * 7000).withColumn("ctx", context)
    (row,) = ops.diagnose(
        df, context="ctx", salient_lines=9, salient_chars=1000, evidence_kept=100
    ).select("evidence", ops.diagnosis_text(evidence_lines=100).alias("t")).collect()
    whole = [f"line {k} failed " + "y" * 300 for k in range(9)]
    assert row.evidence[-9:] == whole and all(line in row.t for line in whole)
    (row,) = ops.with_prompt(df, context="ctx", prompt_chars=1_000_000).collect()
    assert "z" * 7000 in row.prompt and all(line in row.prompt for line in whole)


def test_severity_tiers(spark):
    texts = {"a PANIC": "critical", "an error": "high", "code 4": "medium", "calm": "low"}
    df = spark.createDataFrame([(t, t.lower()) for t in texts], "t string, low string")
    found = df.select("t", ops.infer_severity("low").alias("s")).collect()
    assert {r.t: r.s for r in found} == texts


def test_text_block(lines):
    diagnosed = ops.diagnose(lines("ERROR No space left on device"))
    (row,) = diagnosed.select(ops.diagnosis_text().alias("t")).collect()
    assert row.t.splitlines()[:6] == [
        "[VERY_HIGH] No space left on device", "Source: offline (0 ms)",
        "Root cause: The filesystem reached 100% usage, so writes now fail.", "",
        "Evidence:", "  - Matched rule 'disk_full' on: No space left on device",
    ]
    assert "     $ df -h && df -i" in row.t and "References:" not in row.t


REPLIES = [
    ('{"summary":"All connections taken","confidence":"high","root_cause":"the pool holds too few",'
     '"evidence":["in use: 40 of 40"],"recommendations":[{"title":"Widen the pool","description":"",'
     '"command":"show pools","severity":"high"}],"prevention":["watch the pool"]}',
     dict(provider="m", summary="All connections taken", confidence="high", prevention=["watch the pool"])),
    ("No idea, sorry.",
     dict(provider="offline", summary="Database deadlock / lock contention")),
    ('```json\n{"summary":"Memory ran out","confidence":"very_high","root_cause":"a small limit",'
     '"recommendations":[]}\n```', dict(provider="m", summary="Memory ran out", confidence="very_high")),
    ('{"summary":"v","confidence":"QUITE SURE","root_cause":"w","recommendations":["look again"]}',
     dict(confidence="medium", summary="v")),
    ("[1, 2]", dict(provider="offline")),
    ('{}', dict(provider="m", summary="Unclassified failure", root_cause="Not determined")),
]


def test_reply_merge(spark, lines):
    replies = spark.createDataFrame(
        [(i, "m", r) for i, (r, _) in enumerate(REPLIES)], "id int, provider string, reply string"
    )
    errors = lines(*["ERROR connection pool exhausted"] * len(REPLIES))
    found = ops.merge_replies(errors, replies, "id").orderBy("id").collect()
    for row, (_, wanted) in zip(found, REPLIES):
        assert {k: row[k] for k in wanted} == wanted
        assert row.recommendations
    assert found[0].recommendations[0].command == "show pools"
    assert found[0].evidence == [
        "in use: 40 of 40", "Matched rule 'db_deadlock' on: pool exhausted",
    ]
    # no steps given: the first three of the rule
    assert [s.title for s in found[2].recommendations] == [
        "Capture the deadlock report", "Show blocking statements", "Confirm autovacuum health",
    ]
    assert found[3].recommendations[0].description == "look again"


def test_the_first_readable_reply_counts(spark, lines):
    rows = [(0, "b", "no json", 0), (0, "c", '{"summary":"from c"}', 2), (0, "a", '{"summary":"from a"}', 3),
            (1, "b", '{"summary":"from b"}', 9)]
    replies = spark.createDataFrame(rows, "id int, provider string, reply string, rank int")
    errors = lines("ERROR boom", "ERROR boom")
    ranked = ops.merge_replies(errors, replies, "id").orderBy("id").collect()
    assert [r.summary for r in ranked] == ["from c", "from b"]
    named = ops.merge_replies(errors, replies.drop("rank"), "id").orderBy("id").collect()
    assert [r.summary for r in named] == ["from a", "from b"]
