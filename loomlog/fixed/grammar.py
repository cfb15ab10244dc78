"""Line formats: patterns and key lists.

The patterns use only syntax that means the same in java.util.regex and RE2, so the Spark
operators and the SQL they are checked against share one text.
"""

# The line formats.
ISO_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
ISO_LINE = rf"^({ISO_STAMP})(?:\s+|\s*\]?\s*:\s*)(.*)$"
ENCLOSED_TAG = r"^\s*(\[[^\]]{0,64}\]|\([^)]{0,64}\)|<[^>]{0,64}>)"
TAG_SEPARATORS = " \t:|-–—"
SYSLOG_LINE = (
    r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"([\w.\-]+)\s+([\w.\-/]+?)(?:\[(\d+)\])?:\s*(.*)$"
)
ACCESS_LINE = (
    r"^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"
    r'"([A-Z]+)?\s*([^"]*?)\s*HTTP/([\d.]+)"\s+'
    r"(\d{3})\s+(\d+|-)(?:\s+\S+)*$"
)
BRACKET_LINE = r"^\[([^\]]{4,64})\]\s*\[([A-Za-z]{1,11})\]\s*(.*)$"
LEVEL_WORDS = (
    "TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERR|ERROR|CRIT|CRITICAL|FATAL|PANIC|ALERT|EMERG"
)
LOOSE_LINE = rf"^(.*?)(?:[\s\[\(<]|^)({LEVEL_WORDS})(?:[\s\]\)>:\-]|$)(.*)$"
LEVEL_ANYWHERE = rf"\b({LEVEL_WORDS})\b"
DURATION_MS = r"\b(\d{3,})\s*ms\b"
TOKEN_DECORATIONS = "[]()<>:-,"

# The longest timestamp text kept from a free-form prefix.
LOOSE_PREFIX_CHARS = 80

# JSON keys, in the order they are tried.
JSON_LEVEL_KEYS = ("level", "severity", "log_level", "loglevel", "lvl", "levelname")
JSON_MESSAGE_KEYS = (
    "message", "msg", "log", "event", "error", "err", "text", "description", "detail",
)
JSON_TIME_KEYS = (
    "timestamp", "time", "ts", "@timestamp", "datetime", "asctime", "eventtime", "date",
)
JSON_HOST_KEYS = ("host", "hostname")
JSON_LOGGER_KEYS = ("logger", "name")

# Month abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# An unterminated line is cut at this many characters.
MAX_LINE_CHARS = 65_536

# Which file names count as logs.
LOG_SUFFIXES = (".log", ".txt", ".out", ".err")
LOG_NAME_PARTS = ("log", "error", "access")
