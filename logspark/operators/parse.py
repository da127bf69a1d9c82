"""Lines to entries: the ordered format chain as one staged DataFrame plan.

A working column `_m` starts as the line. Each format rewrites it once, if it fits, into
newline-separated fields headed by the format's tag; a rewritten line is left alone by the formats
after it, so the first match wins. Every format's regex thus runs at most once per line, and only
while no earlier format has accepted it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame

from logspark import fixed
from logspark.functions import json_lines, kv, levels, times
from logspark.functions.text import fields_of, first_match, integer_text, lit, lits, strip, unicode_blanks
from logspark.operators.once import evaluate_once

ENTRY_COLUMNS = ("file", "line_no", "fmt", "ts", "ts_naive", "level", "message", "raw", "meta")
ENTRY_SCHEMA = (
    "file string, line_no bigint, fmt string, ts timestamp, ts_naive boolean, level string, "
    "message string, raw string, meta struct<"
    "syslog:struct<pri:int,severity:int,facility:int,host:string,app:string>,"
    "cef:struct<version:string,device_vendor:string,device_product:string,device_version:string,"
    "signature_id:string,name:string,severity:string,extension:map<string,string>>,"
    "logfmt:map<string,string>,ltsv:map<string,string>>"
)

# The shapes with all Unicode blanks, made cheap: runs that cannot overlap what follows them never
# give back, messages end at their last non-blank, and a blank run has one place where it can start: after a
# non-blank, or after the first character. A syslog tag starts at the end of the blanks before it; only when
# a colon follows them it is the last blank.
_MSG_AT_END = (r"\s*(?<msg>.*)\z", r"\s*+(?<msg>(?:.*\S)?)\s*\z")
_RFC5424 = unicode_blanks(
    fixed.RFC5424.replace(*_MSG_AT_END).replace(r"\s+", r"\s++").replace(r"\S+", r"\S++")
)
_TAG = (r"\s+(?<app>[^:]+):", r"(?:\s++(?=[^:])|\s+(?=\s:))(?<app>[^:]++):")
_RFC3164 = unicode_blanks(
    fixed.RFC3164.replace(*_MSG_AT_END).replace(*_TAG).replace(r"{2}\s+", r"{2}\s++").replace(r"\s+(?<host>\S+)", r"\s++(?<host>\S++)")
)
_ACCESS = unicode_blanks(fixed.ACCESS.replace(r"\s+", r"\s++").replace(r"\S+", r"\S++"))
_BRACKET = unicode_blanks(
    fixed.BRACKET.replace(r"\s+", r"\s++").replace(r"(?<msg>.*)", r"(?<msg>(?:.*\S)?)\s*").replace(r"(?<ts>.+?)", r"(?<ts>.|.+?(?<=\S))")
)
_CEF = unicode_blanks(fixed.CEF)


def _recognise(df: DataFrame, keep: Sequence[str], formats: Sequence[str], keywords: Mapping) -> DataFrame:
    """Add `_tag`, `_p` (fields of the accepted format, NULL if none), `_json` and `_kv`."""
    todo = "NOT startswith(_m, '\n')"
    pairs_type = "array<struct<k:string,v:string>>"
    df = df.selectExpr(*keep, "line AS _m", "CAST(NULL AS variant) AS _json", f"CAST(NULL AS {pairs_type}) AS _kv")

    def step(frame: DataFrame, column: str, condition: str, value: str) -> DataFrame:
        new = f"CASE WHEN {condition} THEN {value} ELSE {column} END AS {column}"
        return frame.selectExpr(*keep, *[new if c == column else c for c in ("_m", "_json", "_kv")])

    for name in formats:
        if name == "syslog":
            fields = ("pri", "ts", "host", "app", "msg")
            df = step(df, "_m", "startswith(_m, '<')", fields_of("_m", _RFC5424, "'rfc5424'", *fields))
            df = step(df, "_m", "startswith(_m, '<')", fields_of("_m", _RFC3164, "'rfc3164'", *fields))
        elif name == "access":
            hit = fields_of("_m", _ACCESS, "'access'", "ip", "ts", "req", "status", "size")
            df = step(df, "_m", f"{todo} AND contains(_m, '[') AND contains(_m, '\"')", hit)
        elif name == "bracket":
            hit = fields_of("_m", _BRACKET, "'bracket'", "ts", "level", "msg")
            df = step(df, "_m", f"{todo} AND contains(_m, ']')", hit)
        elif name == "jsonl":
            maybe = f"{todo} AND contains(_m, '{{') AND {json_lines.looks_like_object('_m')}"
            df = step(df, "_json", maybe, json_lines.json_object("_m"))
            df = step(df, "_m", f"{todo} AND {json_lines.is_single('_json')}", lit("\njsonl"))
        elif name == "cef":
            hit = fields_of(
                "_m", _CEF, "'cef'", "version", "vendor", "product", "release", "signature", "name",
                "severity", "extension",
            )
            df = step(df, "_m", "startswith(_m, 'CEF:')", hit)
        elif name in ("logfmt", "ltsv"):
            mark, pairs = ("=", kv.logfmt_pairs) if name == "logfmt" else ("\t", kv.ltsv_pairs)
            maybe = f"{todo} AND contains(_m, {lit(mark)})"
            df = step(df, "_kv", maybe, pairs("_m"))
            df = step(df, "_m", f"{maybe} AND size(_kv) > 0", lit("\n" + name))
        elif name == "loose":
            df = df.selectExpr("*", f"CASE WHEN {todo} THEN upper(_m) END AS _up")
            level = f"concat('\nloose\n', {first_match(keywords, '_up')})"
            df = step(df, "_m", todo, f"coalesce({level}, _m)")
        else:
            raise ValueError(f"unknown format {name!r}; known: {', '.join(fixed.FORMATS)}")
    df = df.selectExpr(*keep, f"CASE WHEN {todo} THEN NULL ELSE split(_m, '\n') END AS _p", "_json", "_kv")
    return evaluate_once(df, keep, "_p", "_json", "_kv")


def parse_entries(
    lines: DataFrame,
    formats: Sequence[str | Callable] = fixed.FORMATS,
    *,
    as_of: datetime | None = None,
    keywords: Mapping[str, Iterable[str]] = fixed.LOOSE_KEYWORDS,
    bracket_formats: Sequence[str] = fixed.BRACKET_TIME_FORMATS,
    json_time_keys: Sequence[str] = fixed.JSON_TIME_KEYS,
    json_level_keys: Sequence[str] = fixed.LEVEL_KEYS,
    json_message_keys: Sequence[str] = fixed.MESSAGE_KEYS,
    kv_time_keys: Sequence[str] = fixed.KV_TIME_KEYS,
    kv_level_keys: Sequence[str] = fixed.LEVEL_KEYS,
    kv_message_keys: Sequence[str] = fixed.MESSAGE_KEYS,
    hit_level: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Parse `lines(file, line_no, line)` into entries, first matching format wins.

    `as_of` decides the year of syslog times that have none (default: now). Lines no format takes
    are dropped, or, when `hit_level` names a prefilter level column, kept with that level, no time
    and the stripped line as message. A format may also be a function; see `parse_with`. `carry` names
    further columns of `lines` to pass through.
    """
    if any(callable(f) for f in formats):
        from logspark.operators.user import parse_mixed

        kwargs = dict(
            as_of=as_of, keywords=keywords, bracket_formats=bracket_formats,
            json_time_keys=json_time_keys, json_level_keys=json_level_keys,
            json_message_keys=json_message_keys, kv_time_keys=kv_time_keys,
            kv_level_keys=kv_level_keys, kv_message_keys=kv_message_keys,
        )
        return parse_mixed(lines, formats, hit_level=hit_level, carry=carry, **kwargs)

    as_of = as_of or datetime.now(UTC)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=UTC)
    keep = ["file", "line_no", "line", *([hit_level] if hit_level else []), *carry]
    syslog, kv_line = "_tag IN ('rfc5424', 'rfc3164')", "_tag IN ('logfmt', 'ltsv')"

    df = _recognise(lines, keep, formats, keywords)
    df = df.where("_p IS NOT NULL" if hit_level is None else f"_p IS NOT NULL OR {hit_level} IS NOT NULL")

    # Fields of key/value and JSON lines.
    present = {"_jt": json_time_keys, "_jl": json_level_keys, "_jm": json_message_keys}
    df = df.selectExpr(
        *keep, "_p", "get(_p, 1) AS _tag",
        f"map_from_entries(CASE get(_p, 1) WHEN 'cef' THEN {kv.cef_pairs('_p[9]')} "
        "WHEN 'logfmt' THEN _kv WHEN 'ltsv' THEN _kv END) AS _map",
        *[
            f"CASE WHEN get(_p, 1) = 'jsonl' THEN {json_lines.first_present('_json', keys)} END AS {name}"
            for name, keys in present.items()
        ],
    )
    df = df.selectExpr("*", f"{kv.lower_keys('_map')} AS _low")

    # What the key/value and JSON fields say, and the text of the time.
    kv_times = kv.kv_values("_low", kv_time_keys)
    rt = "try_element_at(_map, 'rt')"
    level = (
        f"CASE WHEN {syslog} THEN {levels.pri_level('cast(_p[2] AS int)')} "
        f"WHEN _tag = 'access' THEN {levels.status_level('cast(_p[5] AS int)')} "
        f"WHEN _tag = 'bracket' THEN {levels.exact_level('_p[3]')} "
        f"WHEN _tag = 'jsonl' THEN {levels.exact_level(json_lines.string_only('_jl'))} "
        f"WHEN _tag = 'cef' THEN {levels.cef_level('_p[8]')} WHEN _tag = 'loose' THEN _p[2] "
        f"WHEN {kv_line} THEN {kv.kv_level('_low', kv_level_keys)} {f'ELSE {hit_level}' if hit_level else ''} END"
    )
    df = df.selectExpr(
        *keep, "_p", "_tag", "_map", "_jm", f"{level} AS level",
        f"CASE WHEN _low IS NOT NULL THEN {kv.kv_message('_low', kv_message_keys)} END AS _kvm",
        f"CASE WHEN _tag = 'bracket' THEN _p[2] WHEN _tag IN ('rfc5424', 'rfc3164', 'access') THEN _p[3] "
        f"WHEN _tag = 'jsonl' THEN {json_lines.string_only('_jt')} "
        f"WHEN _low IS NOT NULL THEN coalesce({kv_times}) END AS _time",
        f"CASE WHEN _low IS NOT NULL THEN filter(array({kv_times}), x -> x IS NOT NULL) END AS _times",
        f"CASE WHEN _tag = 'cef' AND {rt} RLIKE '^[0-9]+$' THEN try_cast({rt} AS bigint) END AS _rt",
    )

    # The usual notations are cast directly, all others go by way of a field list.
    carried = [*keep, "_p", "_tag", "_map", "_jm", "level", "_kvm"]
    df = df.selectExpr(
        *carried, "_time", "_times", "_rt",
        f"CASE _tag WHEN 'bracket' THEN {times.usual_bracket('_time', bracket_formats)} "
        f"WHEN 'access' THEN {times.usual_access('_time')} "
        f"WHEN 'rfc3164' THEN {times.usual_yearless('_time', as_of.year)} "
        f"ELSE {times.usual_iso('_time')} END AS _usual",
    )
    zoned = "_tag IN ('bracket', 'access', 'rfc3164')"
    df = df.selectExpr(
        *carried, "_times", "_rt", "_usual", f"NOT {zoned} AND {times.iso_is_naive('_time')} AS _naive",
        f"CASE WHEN _usual IS NULL THEN split(CASE _tag WHEN 'bracket' THEN {times.bracket_fields('_time', bracket_formats)} "
        f"WHEN 'access' THEN {times.access_fields('_time')} WHEN 'rfc3164' THEN {times.yearless_fields('_time', as_of.year)} "
        f"ELSE {times.iso_fields('_time')} END, '\n') END AS _t",
    )
    df = df.selectExpr(
        *carried, "_times", "_rt",
        f"CASE WHEN _usual IS NULL THEN {times.instant('_t')} ELSE try_cast(_usual AS timestamp) END AS _ts",
        f"CASE WHEN _usual IS NULL THEN NOT {zoned} AND {times.is_naive('_t')} ELSE _naive END AS _naive",
    )
    latest = (as_of + timedelta(days=1)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%fZ")
    df = df.selectExpr(
        *carried, "_rt", "_ts", "_naive",
        f"CASE WHEN _ts IS NULL AND size(_times) > 1 THEN {times.first_instant('_times')} END AS _alt",
    )
    df = df.selectExpr(
        *carried,
        f"CASE WHEN _tag = 'rfc3164' AND _ts > TIMESTAMP '{latest}' THEN _ts - INTERVAL '1' YEAR "
        "ELSE coalesce(_ts, _alt.ts, CASE WHEN _rt BETWEEN 0 AND 253402300799999 THEN timestamp_millis(_rt) END) END AS ts",
        "CASE WHEN _ts IS NOT NULL THEN _naive ELSE _alt.naive END AS _naive",
    )
    df = evaluate_once(df, keep, "_p", "_tag", "_map", "_jm", "ts", "_naive", "level", "_kvm")

    # Message and extras, computed only for the rows that pass the filters above.
    app = f"CASE WHEN _tag = 'rfc3164' THEN {strip('_p[5]')} ELSE _p[5] END"
    line = f"({strip('line')})"
    message = (
        f"CASE WHEN {syslog} THEN concat(_p[4], ' ', {app}, CASE WHEN _p[6] = '' THEN '' ELSE concat(': ', _p[6]) END) "
        f"WHEN _tag = 'access' THEN concat(_p[2], ' \"', _p[4], '\" -> ', cast(cast(_p[5] AS int) AS string), "
        f"coalesce(concat(' (', {integer_text('_p[6]')}, ' bytes)'), '')) WHEN _tag = 'bracket' THEN _p[4] "
        f"WHEN _tag = 'jsonl' THEN coalesce({json_lines.as_text('_jm')}, {line}) "
        f"WHEN _tag = 'cef' THEN coalesce(_kvm, CASE WHEN _p[7] <> '' THEN _p[7] END, {line}) "
        f"ELSE coalesce(_kvm, {line}) END"
    )
    pri = "cast(_p[2] AS int)"
    header = ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")
    meta = (
        f"CASE WHEN {syslog} OR {kv_line} OR _tag = 'cef' THEN struct("
        f"CASE WHEN {syslog} THEN struct({pri} AS pri, {pri} % 8 AS severity, shiftright({pri}, 3) AS facility, "
        f"_p[4] AS host, {app} AS app) END AS syslog, "
        f"CASE WHEN _tag = 'cef' THEN struct({', '.join(f'_p[{i}] AS {n}' for i, n in enumerate(header, 2))}, _map AS extension) END AS cef, "
        "CASE WHEN _tag = 'logfmt' THEN _map END AS logfmt, CASE WHEN _tag = 'ltsv' THEN _map END AS ltsv) END"
    )
    return df.selectExpr(
        "file", "cast(line_no AS bigint) AS line_no", f"CASE WHEN {syslog} THEN 'syslog' ELSE _tag END AS fmt",
        "ts", "CASE WHEN ts IS NOT NULL THEN coalesce(_naive, false) END AS ts_naive", "level",
        f"{message} AS message", "line AS raw", f"{meta} AS meta", *carry,
    )
