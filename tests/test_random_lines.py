"""Random lines: the parse plan against the rules stated plainly with the standard library."""

import json
import random
import re
import shlex

import logspark as ls
from logspark import fixed

SCALE = {**dict.fromkeys(range(0, 3), "CRITICAL"), 3: "ERROR", 4: "WARNING", 5: "INFO", 6: "DEBUG", 7: "DEBUG"}
FRAGMENTS = [
    "<34>", "<13>1", "<999>1", "2025-12-30T08:12:04Z", "Dec 29 10:06:00", "host", "app[3]:", "tag:", "-", "[x y]", "[INFO]", "[warn]",
    "[Error]", " ", "  ", "\t", " ", "\x1c", "\x85", "a=1", "msg=hello", 'msg="two words"', "level=warn", "LEVEL=crit", "severity=error",
    "k='v w'", "=x", "it's", '"', "\\", 'x="a\\"b"', "level:err", "msg:slow", ":y", "CEF:", "CEF:0|a|b|c|d|name|7|", "CEF:0|a|b|c|d||x", "|", "detail=z",
    'h - - [10/Oct/2000:13:55:36 -0700] "GET /"', '::1 \x85 u\tv [x]  "a b" 503', "127.0.0.1 - - [10/Oct/2000:13:55:36 -0700]", '"GET / HTTP/1.0"', "404 23", "503 -", "200 0012", '"-" "ua"', "{", "}", '{"msg":"m","level":"Error"}',
    '{"level":null,"lvl":"error"}', '{"error":12}', '{"a":[1]}', "ERROR", "failed", "Warn", "information", "trace", "panic", "é", "ınfo", "straße", ",", "1", "x",
]


def shell_words(line):
    try:
        return shlex.split(line)
    except ValueError:
        return []


def fields(words, sep):
    split = (w.split(sep, 1) for w in words if w.find(sep) > 0)
    return {k: v for k, v in split}


def common(found):
    """Level and message that key/value fields give."""
    low = {}
    for key, value in found.items():
        low[key.lower()] = value
    names = [fixed.LEVEL_ALIASES.get(n, n) for n in (low.get(k, "").strip().upper() for k in fixed.LEVEL_KEYS)]
    level = next((n for n in names if n in fixed.LEVELS[:5]), "UNKNOWN")
    return level, next((low[k] for k in fixed.MESSAGE_KEYS if low.get(k)), None)


def expected(line):
    """fmt, level, message of a line, or None."""
    text = line.strip()
    for shape in (fixed.RFC5424, fixed.RFC3164):
        m = re.fullmatch(shape.replace("(?<", "(?P<").replace(r"\z", ""), line, re.S)
        if m:
            head, body = f"{m['host']} {m['app'].strip()}", m["msg"].strip()
            return "syslog", SCALE[int(m["pri"]) % 8], f"{head}: {body}" if body else head
    m = re.fullmatch(fixed.ACCESS.replace("(?<", "(?P<").replace(r"\z", ""), line, re.S)
    if m:
        code = int(m["status"])
        size = f" ({int(m['size'])} bytes)" if re.fullmatch(r"[+-]?\d+", m["size"]) else ""
        level = {5: "ERROR", 4: "WARNING"}.get(code // 100, "INFO")
        return "access", level, f'{m["ip"]} "{m["req"]}" -> {code}{size}'
    m = re.fullmatch(fixed.BRACKET.replace("(?<", "(?P<").replace(r"\z", ""), line, re.S)
    if m:
        name = m["level"].upper()
        return "bracket", name if name in fixed.LEVELS else "UNKNOWN", m["msg"].strip()
    if text[:1] == "{" and text[-1:] == "}":
        try:
            obj = json.loads(text)
        except ValueError:
            obj = None
        if obj is not None:
            name = next((obj[k] for k in fixed.LEVEL_KEYS if k in obj), None)
            name = name.upper() if isinstance(name, str) else None
            value = next((obj[k] for k in fixed.MESSAGE_KEYS if k in obj), None)
            return "jsonl", name if name in fixed.LEVELS else "UNKNOWN", text if value is None else str(value)
    parts = line.split("|", 7)
    if line.startswith("CEF:") and len(parts) > 6:
        _, message = common(fields((parts + [""])[7].split(), "="))
        known = re.fullmatch(r"\s*[+-]?\d+\s*", parts[6])
        grade = min(max(int(parts[6]), 0), 9) if known else None
        level = "UNKNOWN" if grade is None else ["INFO", "INFO", "INFO", "INFO", "WARNING", "WARNING", "WARNING", "ERROR", "ERROR", "CRITICAL"][grade]
        return "cef", level, message or parts[5] or text
    for fmt, found in (("logfmt", fields(shell_words(line), "=")), ("ltsv", fields(line.split("\t"), ":") if "\t" in line else {})):
        if found:
            level, message = common(found)
            return fmt, level, message or text
    for level, words in fixed.LOOSE_KEYWORDS.items():
        if any(w in line.upper() for w in words):
            return "loose", level, text
    return None


def test_random_lines(spark):
    rng = random.Random(5)
    texts = set()
    while len(texts) < 12000:
        parts = [rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 9))]
        texts.add(rng.choice([" ", " ", "", "\t"]).join(parts))
    texts = sorted(texts)
    df = spark.createDataFrame([("f", n, t) for n, t in enumerate(texts)], "file string, line_no bigint, line string")
    got = {r.line_no: (r.fmt, r.level, r.message) for r in ls.parse_entries(df.repartition(8)).collect()}
    wrong = [(t, got.get(n), expected(t)) for n, t in enumerate(texts) if got.get(n) != expected(t)]
    # A JSON object as message is written as JSON here, not in Python's notation.
    wrong = [w for w in wrong if not (w[1] and w[2] and w[1][0] == w[2][0] == "jsonl" and w[1][:2] == w[2][:2] and w[2][2].startswith(("{", "[")))]
    assert not wrong, f"{len(wrong)}\n" + "\n".join(map(repr, wrong[:40]))
    assert {e[0] for e in map(expected, texts) if e} == set(fixed.FORMATS)
