"""Time text to instants.

The usual notations are cast directly. Every other accepted one is rewritten (one regex) to the same
list of fields, and one builder turns that list into a UTC instant. Fields: year, month, day, ISO week,
week day, hour, minute, second, fraction, stray text before the offset, offset sign, hour, minute,
second, fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.fixed import ACCESS_TIME_FORMAT, MONTHS, WS
from logspark.functions.text import fields_of, lit, strip

N_FIELDS = 16  # a leading empty field, then the 15 named above

# Minutes, seconds and a fraction, which may follow hours and minutes too.
_CLOCK = (
    r"(?::(?<Pia>\d\d)(?::(?<Psa>\d\d))?|(?<Pib>\d\d)(?<Psb>\d\d)?)?"
    r"(?:[.,](?<Pfa>\d++)|(?<=:\d\d:\d\d):(?<Pfb>\d++))?"
)
_ISO = (
    r"(?s)\A(?<y>\d{4})"
    r"(?:-(?<ma>\d\d)-(?<da>\d\d)|(?<mb>\d\d)(?<db>\d\d)"
    r"|-W(?<wa>\d\d)(?:-(?<ka>\d)(?!\d))?|W(?<wb>\d\d)(?<kb>\d)?)"
    r"(?:.(?<h>\d\d)" + _CLOCK.replace("<P", "<")
    + r"(?<x>[^+\-]*)(?:(?<g>[+\-])(?<oh>\d\d)" + _CLOCK.replace("<P", "<o") + r")?)?\z"
)
_ISO_FIELDS = (
    "y", "ma+mb", "da+db", "wa+wb", "ka+kb", "h", "ia+ib", "sa+sb", "fa+fb", "x", "g", "oh",
    "oia+oib", "osa+osb", "ofa+ofb",
)


def iso_fields(text: str) -> str:
    """Fields of an ISO 8601 date or date-time; other text comes back unchanged."""
    return fields_of(f"translate(replace({text}, 'Z', '+00:00'), '\n', '\t')", _ISO, *_ISO_FIELDS)


# strptime directives as groups; one- and two-digit numbers are both fine there.
_DIRECTIVES = {
    "Y": r"(?<y>[0-9]{4})",
    "m": r"(?<m>1[0-2]|0[1-9]|[1-9])",
    "d": r"(?<d>3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])",
    "b": r"(?<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    "H": r"(?<h>2[0-3]|[0-1][0-9]|[0-9])",
    "M": r"(?<i>[0-5][0-9]|[0-9])",
    "S": r"(?<s>6[0-1]|[0-5][0-9]|[0-9])",
    "f": r"(?<f>[0-9]{1,6})",
    "z": r"(?:(?<g>[+-])(?<oh>[0-9][0-9])(?:(?<oi>[0-5][0-9])(?:(?<os>[0-5][0-9])(?:\.(?<of>[0-9]{1,6}))?)?"
         r"|:(?<oj>[0-5][0-9])(?::(?<ot>[0-5][0-9])(?:\.(?<ov>[0-9]{1,6}))?)?)|(?-i:Z))",
}


def strptime_pattern(fmt: str) -> str:
    """Pattern of a strptime format (directives Y m d b H M S f z)."""
    out, at = "(?iU)\\A", 0
    while at < len(fmt):
        char = fmt[at]
        if char == "%":
            at += 1
            if fmt[at : at + 1] not in _DIRECTIVES:
                raise ValueError(f"unsupported directive %{fmt[at : at + 1]} in {fmt!r}")
            out += _DIRECTIVES[fmt[at]]
        elif char.isspace():
            out += "" if out.endswith(WS + "+") else WS + "+"
        else:
            out += char if char.isalnum() else "\\" + char
        at += 1
    return out + r"\z"


def strptime_fields(text: str, fmt: str, year: int | None = None) -> str:
    """Fields of a text in a strptime format, which may lack the year; other text stays as it is."""
    pattern = strptime_pattern(fmt)
    have = lambda name: name if f"(?<{name}>" in pattern else ""
    fields = [have("y") if year is None else f"'{year:04d}'", have("m"), have("d"), "", ""]
    fields += [have("h"), have("i"), have("s"), have("f"), ""]
    fields += ["g", "oh", "oi+oj", "os+ot", "of+ov"] if have("g") else [""] * 5
    return fields_of(text, pattern, *fields)


_DAY = """
concat({p}[1], '-',
       lpad(CASE WHEN char_length({p}[2]) = 3
                 THEN cast(div(instr('%s', lower({p}[2])) + 2, 3) AS string)
                 ELSE {p}[2] END, 2, '0'),
       '-', lpad(trim({p}[3]), 2, '0'))""" % MONTHS
_MONDAY = "cast(date_trunc('week', try_cast(concat({p}[1], '-01-04') AS timestamp)) AS date)"
_WEEK_DAY = "CASE WHEN {p}[5] = '' THEN 1 ELSE cast({p}[5] AS int) END"
_WEEK_DATE = f"date_add({_MONDAY}, (cast({{p}}[4] AS int) - 1) * 7 + {_WEEK_DAY} - 1)"
_DATE = f"""
CASE WHEN {{p}}[4] = '' THEN {_DAY}
     WHEN {_WEEK_DAY} BETWEEN 1 AND 7 AND weekofyear({_WEEK_DATE}) = cast({{p}}[4] AS int)
     THEN cast({_WEEK_DATE} AS string) END"""
_LOCAL = f"""
try_cast(concat({_DATE}, ' ', lpad({{p}}[6], 2, '0'), ':', lpad({{p}}[7], 2, '0'), ':', lpad({{p}}[8], 2, '0'),
                CASE WHEN {{p}}[9] = '' THEN 'Z' ELSE concat('.', substring({{p}}[9], 1, 6), 'Z') END) AS timestamp)"""
_OFFSET = """
(cast(concat('0', {p}[12]) AS bigint) * 3600000000 + cast(concat('0', {p}[13]) AS bigint) * 60000000
 + cast(concat('0', {p}[14]) AS bigint) * 1000000 + cast(rpad(substring({p}[15], 1, 6), 6, '0') AS bigint))"""
_STRAY_OK = """
({p}[10] = '' OR ({p}[11] <> '' AND CASE WHEN {p}[9] = ''
  THEN char_length({p}[10]) = 1 AND octet_length({p}[10]) = 1 ELSE char_length({p}[9]) >= 6 END))"""
_INSTANT = f"""
CASE WHEN size({{p}}) = {N_FIELDS} AND {{p}}[1] <> '0000' AND {_STRAY_OK} THEN
  CASE WHEN {{p}}[11] = '' THEN {_LOCAL}
       WHEN {_OFFSET} < 86400000000 THEN timestamp_micros(unix_micros({_LOCAL})
            + CASE WHEN {{p}}[11] = '-' THEN {_OFFSET} ELSE - {_OFFSET} END) END END"""


def instant(fields: str) -> str:
    """UTC instant of a field list, NULL when it is not a list or not a real time.

    A list without offset is read as UTC; `is_naive` tells the two apart.
    """
    return _INSTANT.replace("{p}", fields)


def is_naive(fields: str) -> str:
    return f"get({fields}, 11) = ''"


# The usual notations, written with full digits: cast as they are, `Z` added where there is no zone.
_USUAL_DAY, _USUAL_CLOCK = r"(?!0000)\d{4}-\d\d-\d\d", r"\d\d:\d\d:\d\d"
_USUAL_ISO = rf"\A{_USUAL_DAY}[T ]{_USUAL_CLOCK}(?:\.\d{{1,6}})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?\z"
_USUAL_BRACKET = {
    "%Y-%m-%d %H:%M:%S": f"{_USUAL_DAY} {_USUAL_CLOCK}",
    "%Y-%m-%dT%H:%M:%S": f"{_USUAL_DAY}T{_USUAL_CLOCK}",
    "%Y-%m-%dT%H:%M:%SZ": f"{_USUAL_DAY}T{_USUAL_CLOCK}Z",
}
_MONTH_NAMES = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_USUAL_ACCESS = rf"\A\d\d/(?:{_MONTH_NAMES})/(?!0000)\d{{4}}:{_USUAL_CLOCK} [+-](?:0\d|1[0-7])[0-5]\d\z"
_USUAL_YEARLESS = rf"\A(?!Feb 29)(?:{_MONTH_NAMES}) [ \d]\d {_USUAL_CLOCK}\z"


def _month(text: str) -> str:
    return f"lpad(cast(div(instr('{MONTHS}', lower({text})) + 2, 3) AS string), 2, '0')"


def iso_is_naive(text: str) -> str:
    """Whether an ISO text of the usual form has no zone."""
    return f"NOT (endswith({text}, 'Z') OR substring({text}, -6, 1) IN ('+', '-'))"


def usual_iso(text: str) -> str:
    """Castable text of an ISO time in its usual form, NULL for any other."""
    zoned = f"CASE WHEN {iso_is_naive(text)} THEN concat({text}, 'Z') ELSE {text} END"
    return f"CASE WHEN {text} RLIKE {lit(_USUAL_ISO)} THEN {zoned} END"


def usual_bracket(text: str, formats) -> str:
    shapes = "|".join(_USUAL_BRACKET[f] for f in formats if f in _USUAL_BRACKET)
    if not shapes:
        return "CAST(NULL AS STRING)"
    zoned = f"CASE WHEN endswith({text}, 'Z') THEN {text} ELSE concat({text}, 'Z') END"
    return f"CASE WHEN {text} RLIKE {lit(rf'\A(?:{shapes})\z')} THEN {zoned} END"


def usual_access(text: str) -> str:
    part = lambda at, n: f"substring({text}, {at}, {n})"
    date = f"{part(8, 4)}, '-', {_month(part(4, 3))}, '-', {part(1, 2)}"
    rest = f"' ', {part(13, 8)}, {part(22, 3)}, ':', {part(25, 2)}"
    return f"CASE WHEN {text} RLIKE {lit(_USUAL_ACCESS)} THEN concat({date}, {rest}) END"


def usual_yearless(text: str, year: int) -> str:
    part = lambda at, n: f"substring({text}, {at}, {n})"
    date = f"'{year:04d}-', {_month(part(1, 3))}, '-', lpad(trim({part(5, 2)}), 2, '0')"
    return f"CASE WHEN {text} RLIKE {lit(_USUAL_YEARLESS)} THEN concat({date}, ' ', {part(8, 8)}, 'Z') END"


def first_instant(texts: str) -> str:
    """(ts, naive) of the first ISO text in an array that is a real time."""
    usual = f"struct(try_cast({usual_iso('s')} AS timestamp) AS ts, {iso_is_naive('s')} AS naive)"
    other = f"transform(array(split({iso_fields('s')}, '\n')), q -> struct({instant('q')} AS ts, {is_naive('q')} AS naive))"
    one = f"CASE WHEN s RLIKE {lit(_USUAL_ISO)} THEN {usual} ELSE {other}[0] END"
    return f"get(filter(transform({texts}, s -> {one}), x -> x.ts IS NOT NULL), 0)"


def bracket_fields(text: str, formats) -> str:
    """Fields of the first format that fits; a rewritten text no longer fits the next one."""
    out = strip(text)
    for fmt in formats:
        out = strptime_fields(out, fmt)
    return out


def access_fields(text: str) -> str:
    return strptime_fields(text, ACCESS_TIME_FORMAT)


def yearless_fields(text: str, year: int) -> str:
    """Fields of `Mon d HH:MM:SS` in the given year; 29 February is never a date here."""
    leap = lit(rf"(?iU)\Afeb{WS}+29{WS}")
    return f"CASE WHEN NOT {text} RLIKE {leap} THEN {strptime_fields(text, '%b %d %H:%M:%S', year)} END"


def iso_text(ts: Column, naive: Column) -> Column:
    """ISO text: microseconds only when there are any, `+00:00` only for zoned times."""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.unix_micros(ts) % 1000000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""),
        F.when(naive, "").otherwise("+00:00"),
    )
