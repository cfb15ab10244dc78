"""Texts and word lists of the diagnosis."""

# Severity tiers, tried in this order on lower-cased text.
SEVERITY_WORDS = (
    ("critical", ("fatal", "panic", "oom", "out of memory", "corrupt", "core dumped", "abort")),
    ("high", ("error", "exception", "refused", "denied", "deadlock", "traceback", "500")),
    ("medium", ("warn", "timeout", "slow", "429", "4")),
)
DEFAULT_SEVERITY = "low"
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

# Confidence names.
CONFIDENCES = ("low", "medium", "high", "very_high")

# Context lines worth quoting as evidence.
SALIENT_PATTERN = r"\b(error|fatal|critical|exception|refus|timeout|denied|failed)\b"
SALIENT_LINES = 4
SALIENT_CHARS = 180

# What is said when no rule matches.
UNMATCHED_CAUSE = (
    "No known signature matched. This line is most likely a symptom; "
    "correlate it with the preceding errors and the service journal."
)
UNMATCHED_STEPS = (
    ("Read the surrounding journal",
     "Stack context almost always identifies the cause.",
     "journalctl -xe --no-pager -n 80", "high"),
    ("Find the failing unit", "", "systemctl --failed", "medium"),
    ("Correlate by correlation id",
     "Grep the request/trace id across every log file.",
     "grep -R '<correlation-id>' /var/log/", "high"),
)
UNMATCHED_PREVENTION = (
    "Emit structured (JSON) logs so signatures are machine-detectable",
    "Alert on error-rate ratio, not absolute error count",
)
UNTITLED = "Unclassified log event"
GENERAL_CATEGORY = "General"

# Texts used when a reply leaves them out.
REPLY_SUMMARY = "Unclassified failure"
REPLY_CAUSE = "Not determined"

# Sizes.
RULES_KEPT = 3
CONTEXT_LINES = 12
PROMPT_CHARS = 6000
EVIDENCE_KEPT = 8
INPUT_CHARS = 200
TITLE_WORDS = 6
TITLE_CHARS = 80
REPLY_STEPS = 8
REPLY_EVIDENCE = 10
REPLY_PREVENTION = 8
REPLY_BACKSTOP_STEPS = 3
PRIORITY_WEIGHT = 100
