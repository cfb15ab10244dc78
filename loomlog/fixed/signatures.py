"""Error signatures and the gate in front of them."""

from typing import NamedTuple


class Signature(NamedTuple):
    name: str
    category: str
    severity: int
    pattern: str
    hints: tuple[str, ...] | None = None
    ignore_case: bool = True


# The signatures, in declaration order. They are tried by falling severity;
# equal severities keep this order. Hints are lower-case substrings; one must be present.
SIGNATURES = (
    Signature(
        "http_5xx", "HTTP", 45,
        r"\b(?:status(?:_code)?|http(?:/\d(?:\.\d)?)?|response(?:_code)?|code)\W{0,3}(5\d{2})\b"
        r"|\b(?:HTTP\s*)?(?:5\d{2})\s+"
        r"(?:internal server error|bad gateway|service unavailable|gateway time-?out)\b",
        ("5", "status", "http", "gateway"),
    ),
    Signature(
        "http_4xx", "HTTP", 32,
        r"\b(?:status(?:_code)?|http(?:/\d(?:\.\d)?)?|response(?:_code)?|code)\W{0,3}(4\d{2})\b"
        r"|\b(?:HTTP\s*)?(?:4\d{2})\s+"
        r"(?:bad request|unauthorized|forbidden|not found|too many requests)\b",
        ("4", "status", "http"),
    ),
    Signature(
        "python_traceback", "Exception", 45,
        r"\bTraceback \(most recent call last\)|\b[A-Za-z_][\w.]*(?:Error|Exception)\b",
        ("traceback", "error", "exception"),
        ignore_case=False,
    ),
    Signature(
        "panic", "Process", 60,
        r"\b(?:panic|fatal error|segmentation fault|core dumped|abort(?:ed)? trap)\b",
        ("panic", "fatal", "segfault", "core dumped", "abort"),
    ),
    Signature(
        "oom", "Resource", 55,
        r"\bout of memory\b|\boom-?kill(?:ed)?\b|\bMemoryError\b"
        r"|\bJavaScript heap out of memory\b|\bcannot allocate memory\b",
        ("memory", "oom", "allocat"),
    ),
    Signature(
        "disk_full", "Resource", 55,
        r"\bno space left on device\b|\bdisk (?:is )?full\b|\bENOSPC\b",
        ("space", "disk", "enospc"),
    ),
    Signature(
        "db_deadlock", "Database", 45,
        r"\bdeadlock detected\b|\block wait timeout\b|\b(?:connection|pool) exhausted\b",
        ("deadlock", "lock wait", "exhausted"),
    ),
    Signature(
        "db_error", "Database", 42,
        r"\b(?:sql|database|db)\s+(?:error|syntax|exception)\b|\bquery failed\b"
        r"|\b(?:unique|foreign key|not null) constraint\b"
        r"|\b(?:psycopg2|sqlalchemy|pymysql)\.[\w.]*(?:Error|Exception)\b",
        ("sql", "database", "db ", "query", "constraint"),
    ),
    Signature(
        "conn_refused", "Network", 38,
        r"\bconnection refused\b|\bECONNREFUSED\b|\bno route to host\b"
        r"|\bconnection reset by peer\b|\bECONNRESET\b",
        ("refused", "econn", "route to host"),
    ),
    Signature(
        "timeout", "Network", 35,
        r"\btimed? ?out\b|\bETIMEDOUT\b|\bdeadline exceeded\b"
        r"|\breadiness probe failed\b|\bcontext deadline\b",
        ("timed out", "timeout", "etimedout", "deadline"),
    ),
    Signature(
        "permission", "Permission", 38,
        r"\bpermission denied\b|\baccess denied\b|\bEACCES\b|\bEPERM\b"
        r"|\bunauthorized\b|\bforbidden\b",
        ("permission", "denied", "eacces", "eperm", "forbidden", "unauthorized"),
    ),
    Signature(
        "auth_failure", "Security", 40,
        r"\bauthentication fail(?:ed|ure)\b|\binvalid (?:credentials|token|password|api key)\b"
        r"|\blogin failed\b|\btoken (?:expired|revoked)\b"
        r"|\b(?:failed|invalid|incorrect) (?:password|credentials|login)\b",
        ("auth", "credential", "token", "login", "password"),
    ),
    Signature(
        "certs", "Security", 42,
        r"\b(?:x509|certificate verify failed|certificate has expired|ssl handshake"
        r"|unable to get local issuer|self signed)\b",
        ("certificate", "x509", "ssl", "tls", "issuer"),
    ),
    Signature(
        "dns", "Network", 35,
        r"\b(?:NXDOMAIN|name or service not known|temporary failure in name resolution"
        r"|dns resolution failed)\b",
        ("dns", "resolve", "nxdomain", "host not found"),
    ),
    Signature(
        "dependency_down", "Availability", 40,
        r"\b(?:circuit breaker (?:open|half[- ]open)|service unavailable|no healthy upstream"
        r"|could not connect to (?:host|server|broker))\b",
        ("circuit breaker", "upstream", "unavailable", "broker"),
    ),
    Signature(
        "slow_query", "Performance", 25,
        r"\bslow quer(?:y|ies)\b|\bquery took (\d{3,})ms\b"
        r"|\b(?:took|exceeded|duration) (\d{3,})ms\b",
        ("slow", "ms", "duration"),
    ),
    Signature(
        "throttle", "Resource", 42,
        r"\btoo many open files\b|\bEMFILE\b|\bENOMEM\b|\bthrottl(?:ed|ing)\b"
        r"|\brate limit(?:ed)? exceeded\b|\b429\b",
        ("open files", "emfile", "enomem", "throttl", "rate limit"),
    ),
    Signature(
        "corruption", "Data", 55,
        r"\b(?:data (?:corruption|corrupted)|checksum mismatch|journal file .* is corrupt"
        r"|malformed packet|unexpected eof)\b",
        ("corrupt", "checksum", "malformed"),
    ),
)

# A text that holds none of these words (in any case) and no run matching the
# number pattern is never classified.
GATE_WORDS = (
    "error", "exception", "fail", "fatal", "panic", "critical", "warn", "refus", "timeout",
    "timed out", "denied", "unauthor", "forbidden", "deadlock", "oom", "memory", "disk",
    "space", "traceback", "status", "slow", "unavailable", "reset", "certificate", "ssl",
    "upstream", "circuit",
)
GATE_NUMBERS = r"429|5\d\d|4\d\d"

# Access-log status classes -> signature set without classification.
ACCESS_SERVER_ERROR = "http_5xx"
ACCESS_CLIENT_ERROR = "http_4xx"
HEALTHY_PREFIX = "ok:"
