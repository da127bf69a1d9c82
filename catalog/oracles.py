"""Expected rows of the registered queries, as SQL over the given tables.

The expectations come from the table's columns, not from reading rendered lines back.
"""

from __future__ import annotations

from catalog.render import CHAIN, FILE_EVENTS
from logspark.fixed import REDACTIONS

_E = f"""
WITH e AS (
  SELECT *, 'user ' || user_id || ' paid ' || cents AS msg,
    regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS us,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS us6,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS sec, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS tsec,
    row_number() OVER (PARTITION BY event_type, event_id // {FILE_EVENTS} ORDER BY event_id) AS line_no,
    event_type || '/' || (event_id // {FILE_EVENTS}) AS file
  FROM (
    SELECT event_id, event_type, user_id, ts, date_trunc('second', ts) AS s, CAST(round(value * 100) AS BIGINT) AS cents,
      CASE user_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'INFO' ELSE 'DEBUG' END AS lvl,
      CASE user_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 7 END AS sev,
      'web' || (user_id % 7) AS host
    FROM events) AS base)
"""

_INTRO = """You are given lines of an application log that may hide an incident.
Already known elsewhere, so not shown: CRITICAL, ERROR, WARNING.
Reply with one JSON object, shaped {"findings":[{"line_numbers":[int],"severity_guess":"low|medium|high","confidence":0..1,"title":str,"rationale":str,"recommendation":str}]}, and nothing else.
Name in line_numbers only numbers that stand below. No suspicion means an empty list.

LOG LINES:
"""

# Expected fields per rendering: fmt, ts, level, message.
_STATUS = "CASE user_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 200 ELSE 301 END"
_CEF_SEV = "CASE user_id % 5 WHEN 0 THEN '10' WHEN 1 THEN '8' WHEN 2 THEN '5' WHEN 3 THEN '2' ELSE 'High' END"
_LOGFMT_ODD = "'ts=soon Level=none @timestamp=' || us6 || ' severity=crit id=1 id=' || event_id"
_LTSV_ODD = "'time:' || us6 || 'Z' || chr(9) || 'level:' || lower(lvl) || chr(9) || 'host:' || host || chr(9) || 'note:' || msg"
_LOOSE = (
    "CASE user_id % 5 WHEN 0 THEN 'kernel panic at' WHEN 1 THEN 'Traceback in' WHEN 2 THEN 'timeout of' "
    "WHEN 3 THEN 'information on' ELSE 'trace of' END || ' step ' || event_id || ' for user ' || user_id"
)
_TOKENS = (
    "'svc ' || CASE user_id % 5 WHEN 0 THEN 'Fatal stop' WHEN 1 THEN 'call failed' WHEN 2 THEN 'warn low disk' "
    "WHEN 3 THEN 'Info ping' ELSE 'nothing new' END || ' id ' || event_id"
)
_BACK = "regexp_replace(strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"
EXPECT = {
    "syslog5424": ("'syslog'", "us || '+00:00'", "lvl", "host || ' ' || event_type || ': ' || msg"),
    "syslog3164": (
        "'syslog'",
        "strftime(CASE WHEN s > TIMESTAMP '2024-01-16 12:00:00' THEN s - INTERVAL 1 YEAR ELSE s END, '%Y-%m-%dT%H:%M:%S') || '+00:00'",
        "lvl", "host || ' ' || event_type || '[77]: ' || msg",
    ),
    "access": (
        "'access'", "tsec || '+00:00'",
        "CASE WHEN user_id % 5 < 2 THEN 'ERROR' WHEN user_id % 5 = 2 THEN 'WARNING' ELSE 'INFO' END",
        f"'10.0.' || (user_id % 250) || '.7 \"GET /' || event_type || '/' || event_id || ' HTTP/1.1\" -> ' || {_STATUS}"
        " || CASE WHEN event_id % 7 = 0 THEN '' ELSE ' (' || cents || ' bytes)' END",
    ),
    "bracket": ("'bracket'", "tsec || '+00:00'", "lvl", "msg"),
    "bracket5": ("'bracket'", "tsec || '+00:00'", "CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' ELSE lvl END", "msg"),
    "jsonl": (
        "'jsonl'",
        f"CASE event_id % 4 WHEN 0 THEN us || '+00:00' WHEN 1 THEN {_BACK} || '+00:00' WHEN 2 THEN us END",
        "CASE WHEN event_id % 4 = 3 THEN 'UNKNOWN' ELSE lvl END",
        "CASE event_id % 4 WHEN 0 THEN msg WHEN 1 THEN CAST(cents AS VARCHAR) WHEN 2 THEN 'a \"b\" ' || event_id"
        " ELSE '{\"timestamp\":null,\"ts\":\"' || us6 || '\",\"lvl\":\"warn\",\"id\":' || event_id || '}' END",
    ),
    "cef": (
        "'cef'", "regexp_replace(left(us6, 23) || '000', '\\.000000$', '') || '+00:00'",
        "CASE user_id % 5 WHEN 4 THEN 'UNKNOWN' ELSE lvl END",
        "CASE WHEN event_id % 2 = 0 THEN 'done_' || cents ELSE event_type || ' seen' END",
    ),
    "logfmt": (
        "'logfmt'", "CASE WHEN event_id % 2 = 0 THEN us || '+00:00' ELSE us END",
        "CASE WHEN event_id % 2 = 0 THEN lvl ELSE 'CRITICAL' END",
        f"CASE WHEN event_id % 2 = 0 THEN msg || ' \"ok\"' ELSE {_LOGFMT_ODD} END",
    ),
    "ltsv": (
        "'ltsv'", "us || '+00:00'", "lvl", f"CASE WHEN event_id % 2 = 0 THEN msg ELSE {_LTSV_ODD} END",
    ),
    "loose": ("'loose'", "CAST(NULL AS VARCHAR)", "lvl", _LOOSE),
    "tokens": ("'loose'", "CAST(NULL AS VARCHAR)", "lvl", _TOKENS),
}
_META = {
    "syslog5424": ("user_id % 24", "event_type"),
    "syslog3164": ("user_id % 24", "event_type || '[77]'"),
    "logfmt": "CASE WHEN event_id % 2 = 0 THEN '{\"time\":\"' || us6 || 'Z\",\"level\":\"' || lower(lvl) || '\",\"msg\":\"' || msg || ' \\\"ok\\\"\",\"id\":\"' || event_id || '\"}'"
    " ELSE '{\"ts\":\"soon\",\"Level\":\"none\",\"@timestamp\":\"' || us6 || '\",\"severity\":\"crit\",\"id\":\"' || event_id || '\"}' END",
    "ltsv": "'{\"time\":\"' || us6 || 'Z\",\"level\":\"' || lower(lvl) || '\",\"host\":\"' || host || '\",\"' || CASE WHEN event_id % 2 = 0 THEN 'msg' ELSE 'note' END || '\":\"' || msg || '\"}'",
}
_BY_TYPE = {"view": "access", "click": "syslog5424", "purchase": "jsonl", "error": "bracket", "signup": "tokens"}


def _pick(selector: str, cases: dict, at: int) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {k} THEN {EXPECT[n][at]}" for k, n in cases.items()) + " END"


_CHAIN = [_pick("event_id % 8", dict(enumerate(CHAIN)), i) for i in range(4)]
_TYPED = [_pick("event_type", {f"'{k}'": n for k, n in _BY_TYPE.items()}, i) for i in range(4)]


def _columns(fields, *names: str) -> str:
    every = dict(zip(("fmt", "ts", "level", "message"), fields))
    return ", ".join(f"{every[n]} AS {n}" for n in names or every)


def _parse(name: str) -> str:
    extra = ""
    if name.startswith("syslog"):
        facility, app = _META[name]
        extra = (
            f", CAST(8 * ({facility}) + sev AS VARCHAR) AS m_pri, CAST(sev AS VARCHAR) AS m_severity, "
            f"CAST({facility} AS VARCHAR) AS m_facility, host AS m_host, {app} AS m_app"
        )
    elif name == "cef":
        extra = (
            ", '0' AS m_version, 'Acme' AS m_device_vendor, 'Gate' AS m_device_product, '1.' || (user_id % 3) AS m_device_version, "
            f"CAST(event_id AS VARCHAR) AS m_signature_id, event_type || ' seen' AS m_name, {_CEF_SEV} AS m_severity, "
            "'{\"src\":\"10.0.0.' || (user_id % 250) || '\",\"rt\":\"' || (epoch_us(ts) // 1000) || '\"' "
            "|| CASE WHEN event_id % 2 = 0 THEN ',\"msg\":\"done_' || cents || '\"' ELSE '' END || '}' AS m_extension"
        )
    elif name in _META:
        extra = f", {_META[name]} AS meta"
    return f"{_E} SELECT event_id, {_columns(EXPECT[name])}{extra} FROM e"


# Which lines of the one-format-per-type files the prefilter keeps, and with which level.
_HIT = f"""
CASE event_type WHEN 'view' THEN CASE WHEN user_id % 5 < 3 THEN {EXPECT['access'][2]} END
  WHEN 'click' THEN CASE WHEN sev <= 4 THEN lvl END
  WHEN 'purchase' THEN CASE WHEN event_id % 4 = 1 AND lvl <> 'CRITICAL' THEN lvl END
  WHEN 'error' THEN lvl
  ELSE CASE WHEN user_id % 5 < 4 THEN lvl END END"""
_SAMPLE = "event_type IN ('view', 'click', 'purchase', 'error', 'signup')"


def _window(low: str | None, high: str | None) -> str:
    test = " AND ".join(
        f"s {op} TIMESTAMP '{bound}'" for op, bound in ((">=", low), ("<", high)) if bound is not None
    )
    return f"{_E} SELECT event_id, {_columns(EXPECT['bracket'], 'ts', 'level', 'message')} FROM e WHERE {test}"


def _redacted(text: str) -> str:
    for pattern, mask in REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return text


def _segments(where: str = "TRUE") -> str:
    text = _redacted("line_no || ' ' || tsec || '+00:00 [' || lvl || '] ' || msg")
    return f"""{_E}, r AS (
  SELECT file, line_no, {text} AS txt, (row_number() OVER (PARTITION BY file ORDER BY line_no) - 1) // 40 AS segment_id
  FROM e WHERE lvl IN ('INFO', 'DEBUG') AND {where}),
g AS (
  SELECT file, segment_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines,
    string_agg(txt, chr(10) ORDER BY line_no) AS text FROM r GROUP BY file, segment_id)
"""


_SEGMENT = "file, segment_id, first_line, last_line, n_lines, sha256(text) AS text_sha256"
_REVIEWED = """
SELECT file, segment_id, CAST(0 AS BIGINT) AS pos, CAST(first_line AS VARCHAR) AS line_numbers,
  CASE first_line % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity_guess,
  CAST(first_line % 100 AS DOUBLE) / 100 AS confidence, 'line ' || first_line AS title,
  'seen' AS rationale, 'look' AS recommendation
FROM g WHERE first_line % 100 >= 55"""
_WEEK = "s >= TIMESTAMP '2024-01-08' AND s < TIMESTAMP '2024-01-15'"
_JSON_TS = f"CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 90 MINUTE WHEN 2 THEN ts END"
_TYPED_TS = f"CASE event_type WHEN 'purchase' THEN {_JSON_TS} WHEN 'signup' THEN NULL ELSE ts END"
# What the user parser of the queries says of the token lines.
_SVC = (
    "'svc' AS fmt, strftime(TIMESTAMP '2024-01-01' + to_seconds(event_id), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts, "
    f"CASE WHEN user_id % 5 = 1 THEN 'ERROR' ELSE 'INFO' END AS level, substring({_TOKENS}, 5) AS message, '{{\"id\":\"' || event_id || '\"}}' AS meta"
)
_SQL_LINES = f"{_E} SELECT file, line_no, sec || ' [' || lvl || '] ' || msg AS line FROM e"
_CHARSET = f"{_E} SELECT file, line_no, '{{}} ' || host || ' na{{}}ve ' || msg AS line FROM e"
_WIDE = "SELECT file, line_no, host || ' 表示 ソ ' || msg AS line FROM e"
_BODY = "'\",\"level\":\"' || lower({level}) || '\",\"message\":\"' || {message} || '\",\"line_no\":' || event_id"
_QUOTED = f"CASE WHEN event_id % 2 = 0 THEN msg || ' \\\"ok\\\"' ELSE {_LOGFMT_ODD} END"

ORACLES: dict[str, str] = {
    "lines_numbered": _SQL_LINES,
    "lines_gzip": _SQL_LINES,
    "whole_files": f"{_E} SELECT file, string_agg(sec || ' [' || lvl || '] ' || msg || chr(10), '' ORDER BY event_id) AS text FROM e GROUP BY file",
    "lines_cp1252": _CHARSET.format("€", "ï"),
    "lines_latin1": _CHARSET.format("\x80", "ï"),
    "lines_utf16": _CHARSET.format("\x80", "ï"),
    "lines_utf16_marked": f"{_E} {_WIDE} UNION ALL {_WIDE}",
    "lines_shift_jis": f"{_E} {_WIDE}",
    "lines_gb18030": f"{_E} {_WIDE}",
    "bad_bytes_euc_kr_replaced": _CHARSET.format("\ufffd", "\ufffd"),
    "bad_bytes_euc_kr_ignored": _CHARSET.format("", ""),
    "bad_bytes_replaced": _CHARSET.format("\ufffd", "\ufffd"),
    "bad_bytes_ignored": _CHARSET.format("", ""),
    "suffix_allowlist": _SQL_LINES,
    "own_tokens": f"{_E} SELECT event_id, false AS as_given, CASE user_id % 5 WHEN 1 THEN 'ERROR' ELSE 'INFO' END AS hit_level FROM e WHERE user_id % 5 IN (1, 3) "
    "UNION ALL SELECT event_id, true, 'INFO' FROM e WHERE user_id % 5 = 3",
    "default_lookback": _window("2024-01-14 12:00:00", "2024-01-15 12:00:00"),
    "sniff_formats": f"{_E} SELECT DISTINCT file, CASE event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'syslog' "
    "WHEN 'purchase' THEN 'jsonl' WHEN 'error' THEN 'bracket' ELSE 'unknown' END AS detected FROM e",
    "read_and_sniff": f"{_E} SELECT file, CASE any_value(event_type) WHEN 'view' THEN 'access' WHEN 'click' THEN 'syslog' "
    f"WHEN 'purchase' THEN 'jsonl' WHEN 'error' THEN 'bracket' ELSE 'unknown' END AS detected, count({_HIT}) AS hits FROM e GROUP BY file",
    "hits_access": f"{_E} SELECT event_id, {EXPECT['access'][2]} AS hit_level FROM e WHERE user_id % 5 < 3",
    "hits_syslog": f"{_E} SELECT event_id, lvl AS hit_level FROM e WHERE sev <= 4",
    "hits_tokens": f"{_E} SELECT event_id, lvl AS hit_level FROM e WHERE user_id % 5 < 4",
    "scan_hits": f"{_E} SELECT file, line_no, hit_level FROM (SELECT *, {_HIT} AS hit_level FROM e) h WHERE hit_level IS NOT NULL",
    "parse_syslog5424": _parse("syslog5424"),
    "parse_syslog3164": _parse("syslog3164"),
    "parse_access": _parse("access"),
    "parse_bracket": _parse("bracket5"),
    "parse_jsonl": _parse("jsonl"),
    "parse_cef": _parse("cef"),
    "parse_logfmt": _parse("logfmt"),
    "parse_ltsv": _parse("ltsv"),
    "parse_loose": _parse("loose"),
    "parse_chain": f"{_E} SELECT event_id, {_columns(_CHAIN)} FROM e",
    "parse_subset": f"{_E} SELECT event_id, {_columns(_CHAIN)} FROM e WHERE event_id % 8 IN (2, 3)",
    "prefilter_fallback": f"""{_E}
SELECT file, line_no, 'bracket' AS fmt, tsec || '+00:00' AS ts, lvl AS level, msg AS message FROM e WHERE event_id % 2 = 0
UNION ALL
SELECT file, line_no, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), lvl,
  CASE user_id % 5 WHEN 0 THEN 'disk SEVERE wear on ' WHEN 1 THEN 'job FAILURE on ' ELSE 'call DEPRECATED on ' END || host
FROM e WHERE event_id % 2 = 1 AND user_id % 5 < 3""",
    "entries_prefilter": f"{_E} SELECT file, line_no, {_columns(_TYPED)} FROM (SELECT *, {_HIT} AS hit FROM e) h WHERE hit IS NOT NULL",
    "entries_full": f"{_E} SELECT file, line_no, {_columns(_TYPED)} FROM e WHERE event_type <> 'signup' OR user_id % 5 < 4",
    "window_date": _window("2024-01-05", "2024-01-06"),
    "window_hour": _window("2024-01-05 13:00:00", "2024-01-05 14:00:00"),
    "window_week": _window("2024-01-08", "2024-01-15"),
    "window_month": _window("2024-01-01", "2024-02-01"),
    "window_year": _window("2024-01-01", "2025-01-01"),
    "window_lookback": _window("2024-01-14 00:00:00", "2024-01-15 12:00:00"),
    "window_since_until": _window("2024-01-03 02:05:06", "2024-01-09"),
    "default_zone": f"""{_E} SELECT event_id, {_columns(EXPECT['jsonl'], 'ts')} FROM (
  SELECT *, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 90 MINUTE WHEN 2 THEN ts + INTERVAL 5 HOUR END AS utc FROM e) z
WHERE utc IS NULL OR (utc >= TIMESTAMP '2024-01-03 05:00:00' AND utc < TIMESTAMP '2024-01-09 05:00:00')""",
    "no_timestamp_policy": f"{_E} SELECT event_id, {_columns(_CHAIN, 'fmt', 'level')} FROM e WHERE {_WEEK} AND event_id % 8 NOT IN (3, 7)",
    "levels": f"SELECT * FROM ({_E} SELECT event_id, {_columns(_CHAIN, 'fmt', 'level')} FROM e) p WHERE level IN ('ERROR', 'CRITICAL')",
    "contains": f"{_E} SELECT event_id, lvl AS level, msg AS message FROM e WHERE msg LIKE '%paid 12%'",
    "exclude_lines": f"{_E} SELECT event_id, lvl AS level, msg AS message FROM e WHERE cents <= 1000",
    "payload": f"""{_E}
SELECT event_id, '{{"timestamp":"' || tsec || '+00:00' || {_BODY.format(level='lvl', message='msg')} || '}}' AS payload FROM e WHERE event_id % 3 = 0
UNION ALL
SELECT event_id, '{{"timestamp":"' || {EXPECT['logfmt'][1]} || {_BODY.format(level=EXPECT['logfmt'][2], message=_QUOTED)}
  || ',"meta":{{"logfmt":' || {_META['logfmt']} || '}}}}' FROM e WHERE event_id % 3 = 1
UNION ALL
SELECT event_id, '{{"timestamp":null' || substring({_BODY.format(level='lvl', message=_LOOSE)}, 2) || '}}' FROM e WHERE event_id % 3 = 2""",
    "written_payload": f"""{_E}
SELECT event_id, '{{"timestamp":"' || tsec || '+00:00' || {_BODY.format(level='lvl', message='msg')} || '}}' AS payload FROM e WHERE event_id % 3 = 0
UNION ALL
SELECT event_id, '{{"timestamp":"' || {EXPECT['logfmt'][1]} || {_BODY.format(level=EXPECT['logfmt'][2], message=_QUOTED)}
  || ',"meta":{{"logfmt":' || {_META['logfmt']} || '}}}}' FROM e WHERE event_id % 3 = 1
UNION ALL
SELECT event_id, '{{"timestamp":null' || substring({_BODY.format(level='lvl', message=_LOOSE)}, 2) || '}}' FROM e WHERE event_id % 3 = 2""",
    "written_entries": f"{_E} SELECT file, line_no, lvl AS level, msg AS message, true AS in_order, count(*) OVER () AS n_written FROM e",
    "exclude_before_parse": f"{_E} SELECT event_id, lvl AS level, msg AS message FROM e WHERE event_id % 50 <> 7",
    "reviewer_failures": f"{_segments()} SELECT file, segment_id, 'RuntimeError: no answer' AS error FROM g WHERE first_line % 3 = 1",
    "redact_documents": f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, {_redacted('line')} AS text FROM d""",
    "segments": f"{_segments()} SELECT {_SEGMENT}, text FROM g",
    "segments_many_splits": f"{_segments()} SELECT {_SEGMENT}, text FROM g",
    "segments_dedup": f"""{_E}, r AS (SELECT event_id % 7 AS source, event_id // 7 + 1 AS n, (event_id // 7 + 1) || ' - [INFO] [' || lvl || '] step' AS txt FROM e),
g AS (SELECT source, (n - 1) // 2 AS s, count(*) AS n_lines, string_agg(txt, chr(10) ORDER BY n) AS text FROM r GROUP BY ALL)
SELECT min(7 * s + source) AS segment_id, n_lines, text FROM g GROUP BY n_lines, text""",
    "prompts": f"{_segments()} SELECT {_SEGMENT}, '{_INTRO}' || text || chr(10) AS prompt FROM g",
    "review_fn": _segments() + _REVIEWED,
    "stored_answers": _segments() + _REVIEWED,
    "findings": f"""{_E}, f AS (
  SELECT event_id, 0 AS pos, event_id || ',' || (event_id + 1) AS line_numbers, 'high' AS severity_guess,
    CAST(cents % 100 AS DOUBLE) / 100 AS confidence, 't ' || user_id AS title, 'r' AS rationale, 'c' AS recommendation FROM e WHERE event_id % 10 > 5
  UNION ALL SELECT event_id, 1, '', 'low', 0.55, 'x', 'y', 'z' FROM e WHERE event_id % 10 > 5)
SELECT event_id, CAST(pos AS BIGINT) AS pos, line_numbers, severity_guess, confidence, title, rationale, recommendation FROM f WHERE confidence >= 0.55""",
    "findings_rejected": "SELECT event_id FROM events WHERE event_id % 10 IN (0, 3, 4, 5)",
    "user_parser": f"{_E} SELECT event_id, {_SVC} FROM e WHERE user_id % 5 < 4",
    "user_chain": f"{_E} SELECT event_id, {_columns(_TYPED)}, CAST(NULL AS VARCHAR) AS meta FROM e WHERE event_type <> 'signup' "
    f"UNION ALL SELECT event_id, {_SVC} FROM e WHERE event_type = 'signup' AND user_id % 5 < 4",
    "own_tables": f"""{_E}
SELECT event_id, 'logfmt' AS fmt, CASE WHEN event_id % 2 = 1 THEN us END AS ts, CASE WHEN event_id % 2 = 1 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS level,
  CAST(event_id AS VARCHAR) AS message FROM e
UNION ALL SELECT event_id, 'jsonl', CASE WHEN event_id % 4 = 2 THEN us END, CASE WHEN event_id % 4 = 2 THEN lvl ELSE 'UNKNOWN' END,
  CASE event_id % 4 WHEN 0 THEN '{{"timestamp":"' || us6 || 'Z","level":"' || lower(lvl) || '","message":"' || msg || '"}}'
    WHEN 1 THEN '{{"ts":"' || us6 || '+01:30", "level":"' || lower(lvl) || '", "msg":' || cents || '}}'
    WHEN 2 THEN 'a "b" ' || event_id ELSE CAST(event_id AS VARCHAR) END FROM e
UNION ALL SELECT event_id, 'bracket', CASE WHEN event_id % 5 = 3 THEN tsec || '+00:00' END, {EXPECT['bracket5'][2]}, msg FROM e
UNION ALL SELECT event_id, 'loose', NULL, CASE WHEN user_id % 5 = 0 THEN 'ERROR' ELSE 'INFO' END, {_LOOSE} FROM e
  WHERE user_id % 5 IN (0, 4) OR starts_with(CAST(user_id AS VARCHAR), '1')""",
    "missing_files": f"{_E} SELECT file, count(*) AS n_lines, 'PATH_NOT_FOUND' AS error FROM e GROUP BY file",
    "triage": f"{_E} SELECT file, line_no, tsec || '+00:00' AS ts, lvl AS level, msg AS message FROM e "
    "WHERE s >= TIMESTAMP '2024-01-05' AND s < TIMESTAMP '2024-01-06' AND lvl IN ('WARNING', 'ERROR')",
    "triage_skipping": f"{_E} SELECT file, line_no, tsec || '+00:00' AS ts, lvl AS level, msg AS message FROM e "
    "WHERE s >= TIMESTAMP '2024-01-05' AND s < TIMESTAMP '2024-01-06' AND lvl IN ('WARNING', 'ERROR')",
    "time_zones": f"""{_E}, t AS (SELECT file, event_type IN ('view', 'click', 'error') AS timed, event_type = 'purchase' AS kept, sec FROM e)
SELECT file, min(sec) FILTER (timed) AS least, max(sec) FILTER (timed) AS greatest, count(*) FILTER (kept) AS open FROM t GROUP BY file""",
    "triage_full": f"""SELECT file, line_no, ts, level, message FROM ({_E}
  SELECT file, line_no, event_type, user_id, event_id, {_columns(_TYPED, 'ts', 'level', 'message')}, {_TYPED_TS} AS utc FROM e) p
WHERE level <> 'UNKNOWN' AND (event_type <> 'signup' OR (user_id % 5 < 4 AND contains(CAST(event_id AS VARCHAR), '1')))
  AND (utc IS NULL OR (utc >= TIMESTAMP '2024-01-08' AND utc < TIMESTAMP '2024-01-15'))""",
    "review_dataset": f"{_segments(_WEEK)} SELECT {_SEGMENT}, text FROM g",
    "triage_with_review": _segments(_WEEK) + _REVIEWED,
    "triage_with_review_identified": f"{_E} SELECT file, line_no, tsec || '+00:00' AS ts, lvl AS level, msg AS message FROM e "
    f"WHERE {_WEEK} AND lvl IN ('WARNING', 'ERROR', 'CRITICAL')",
}
