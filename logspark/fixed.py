"""Names, patterns and word lists that decide the results.

They are data, not logic; everything that uses them lives in the sibling packages.
"""

# ---------------------------------------------------------------- levels
LEVELS = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "UNKNOWN")

DEFAULT_LEVELS = ("WARNING", "ERROR")
REVIEW_IDENTIFIED_LEVELS = ("WARNING", "ERROR", "CRITICAL")
REVIEW_LEVELS = ("INFO", "DEBUG", "UNKNOWN")
ALL_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

LEVEL_ALIASES = {
    "WARN": "WARNING",
    "ERR": "ERROR",
    "FATAL": "CRITICAL",
    "CRIT": "CRITICAL",
    "SEVERE": "CRITICAL",
}

# ---------------------------------------------------------------- formats, in chain order
FORMATS = ("syslog", "access", "bracket", "jsonl", "cef", "logfmt", "ltsv", "loose")
DETECTED = ("access", "syslog", "jsonl", "bracket", "unknown")

# ---------------------------------------------------------------- prefilter tokens
SCAN_TOKENS = {
    "CRITICAL": ("[CRITICAL]", " CRITICAL ", "[FATAL]", " FATAL ", " SEVERE ", " PANIC ", " EMERG "),
    "ERROR": ("[ERROR]", " ERROR ", ' "level":"error"', " level=error", " EXCEPTION", " TRACEBACK",
              " FAILED", " FAILURE"),
    "WARNING": ("[WARNING]", " WARNING ", " WARN ", ' "level":"warning"', " level=warning",
                " DEPRECATED", " RETRY", " TIMEOUT"),
    "INFO": ("[INFO]", " INFO ", ' "level":"info"', " level=info"),
    "DEBUG": ("[DEBUG]", " DEBUG ", ' "level":"debug"', " level=debug", " TRACE "),
}

# ---------------------------------------------------------------- loose keywords
LOOSE_KEYWORDS = {
    "CRITICAL": ("CRITICAL", "FATAL", "PANIC"),
    "ERROR": ("ERROR", "EXCEPTION", "TRACEBACK", "FAILED"),
    "WARNING": ("WARNING", "WARN", "TIMEOUT", "RETRY"),
    "INFO": ("INFO",),
    "DEBUG": ("DEBUG", "TRACE"),
}

# ---------------------------------------------------------------- field names
JSON_TIME_KEYS = ("timestamp", "time", "ts")
KV_TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
LEVEL_KEYS = ("level", "severity", "lvl", "log_level")
MESSAGE_KEYS = ("message", "msg", "error", "detail")

# ---------------------------------------------------------------- line shapes (flags s and U)
RFC5424 = (
    r"\A<(?<pri>[0-9]{1,3})>[0-9]\s+(?<ts>\S+)\s+(?<host>\S+)\s+(?<app>\S+)\s+\S+\s+\S+\s*"
    r"(?:\[[^\]]*\]|-)?\s*(?<msg>.*)\z"
)
RFC3164 = (
    r"\A<(?<pri>[0-9]{1,3})>(?<ts>[A-Z][a-z]{2}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})\s+"
    r"(?<host>\S+)\s+(?<app>[^:]+):\s*(?<msg>.*)\z"
)
ACCESS = (
    r'\A(?<ip>\S+)\s+\S+\s+\S+\s+\[(?<ts>[^\]]+)\]\s+"(?<req>[^"]+)"\s+'
    r'(?<status>[0-9]{3})\s+(?<size>\S+)(?:\s+"[^"]*"\s+"[^"]*")?.*\z'
)
BRACKET = r"\A(?<ts>.+?)\s+\[(?<level>[A-Za-z]+)\]\s+(?<msg>.*)\z"
CEF = (
    r"\ACEF:(?<version>[^|]*)\|(?<vendor>[^|]*)\|(?<product>[^|]*)\|(?<release>[^|]*)\|(?<signature>[^|]*)"
    r"\|(?<name>[^|]*)\|(?<severity>[^|]*)(?:\|(?<extension>.*))?\z"
)

# ---------------------------------------------------------------- time formats of bracketed lines
BRACKET_TIME_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y/%m/%d %H:%M:%S",
    "%d-%m-%Y %H:%M:%S",
)
ACCESS_TIME_FORMAT = "%d/%b/%Y:%H:%M:%S %z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# ---------------------------------------------------------------- blanks
# Unicode blanks as a trim set, and as a class in patterns that start with the flag U.
BLANKS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"

# ---------------------------------------------------------------- redaction, in order
REDACTIONS = (
    (r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", "<REDACTED_JWT>"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<REDACTED_EMAIL>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<REDACTED_IP>"),
    (r"\b(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\b", "<REDACTED_IP>"),
    (r"\b[a-zA-Z0-9_\-]{32,}\b", "<REDACTED_TOKEN>"),
)

# ---------------------------------------------------------------- format sniffing
SNIFF_ACCESS = r'^\S+\s+\S+\s+\S+\s+\[[^\]]+\]\s+"[^"]+"\s+(\d{3})\s+'
SNIFF_SYSLOG = r"^<(\d{1,3})>"
SNIFF_BRACKET = r"(?i)\[\s*(ERROR|WARN(?:ING)?|INFO|DEBUG|CRITICAL)\s*\]"
SNIFF_LINES = 120
SNIFF_BYTES = 4096

# ---------------------------------------------------------------- review
SEGMENT_LINES = 40
MIN_CONFIDENCE = 0.55
# Seconds between a reviewer's tries: the first pause, doubled up to the longest.
REVIEW_PAUSE = 1.0
REVIEW_LONGEST_PAUSE = 8.0
FINDING_SEVERITIES = ("low", "medium", "high")

# ---------------------------------------------------------------- files
ALLOWED_SUFFIXES = ("log", "txt", "md")
