"""Log levels."""

# Level name -> numeric level.
LEVELS = {
    "TRACE": 1,
    "DEBUG": 10,
    "INFO": 20,
    "NOTICE": 25,
    "WARN": 30,
    "ERROR": 40,
    "CRITICAL": 50,
    "FATAL": 60,
}

# Accepted spelling -> level name.
ALIASES = {
    "TRACE": "TRACE",
    "VERBOSE": "TRACE",
    "V": "TRACE",
    "DEBUG": "DEBUG",
    "DBG": "DEBUG",
    "D": "DEBUG",
    "INFO": "INFO",
    "INFORMATION": "INFO",
    "NOTICE": "NOTICE",
    "I": "INFO",
    "WARN": "WARN",
    "WARNING": "WARN",
    "ERR": "ERROR",
    "ERROR": "ERROR",
    "E": "ERROR",
    "CRITICAL": "CRITICAL",
    "CRIT": "CRITICAL",
    "FATAL": "FATAL",
    "EMERG": "FATAL",
    "EMERGENCY": "FATAL",
    "ALERT": "FATAL",
    "PANIC": "FATAL",
}

# Characters that may decorate a level word.
DECORATIONS = "[]()<>:-_,; \t"

# Words a user may give as minimum level (aliases are not accepted there).
FILTER_WORDS = (
    "TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL",
)

# Numeric syslog severity -> level name.
SYSLOG_SEVERITY = {
    0: "FATAL", 1: "FATAL", 2: "CRITICAL", 3: "ERROR",
    4: "WARN", 5: "NOTICE", 6: "INFO", 7: "DEBUG",
}

DEFAULT_LEVEL = LEVELS["INFO"]
WARN = LEVELS["WARN"]
ERROR = LEVELS["ERROR"]
