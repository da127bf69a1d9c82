"""Severity of coded fields, as SQL text."""

from __future__ import annotations

from logspark.fixed import LEVELS
from logspark.functions.text import integer_text, lit, strip

# Level by syslog severity (PRI modulo 8) and by CEF severity 0 to 9 (9 and above).
PRI_LEVELS = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "DEBUG")
CEF_LEVELS = ("INFO",) * 4 + ("WARNING",) * 3 + ("ERROR",) * 2 + ("CRITICAL",)


def _array(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def pri_level(pri: str) -> str:
    """Level of a syslog PRI number."""
    return f"get({_array(PRI_LEVELS)}, ({pri}) % 8)"


def status_level(status: str) -> str:
    """Level of an HTTP status."""
    return f"CASE div({status}, 100) WHEN 5 THEN 'ERROR' WHEN 4 THEN 'WARNING' ELSE 'INFO' END"


def cef_level(severity: str) -> str:
    """Level of a CEF severity; names such as `High` say nothing here."""
    text = integer_text(f"({strip(severity)})")
    large = f"CASE WHEN startswith({text}, '-') THEN 'INFO' ELSE 'CRITICAL' END"
    return f"""
CASE WHEN {severity} RLIKE '^[0-9]$' THEN get({_array(CEF_LEVELS)}, cast({severity} AS int))
     WHEN {text} IS NULL THEN 'UNKNOWN' WHEN char_length({text}) > 9 THEN {large}
     ELSE get({_array(CEF_LEVELS)}, greatest(0, least(9, cast({text} AS int)))) END"""


def exact_level(name: str) -> str:
    """A level given by its exact name in any letter case; UNKNOWN for all other names and none."""
    known = ", ".join(f"{lit(n)}, {lit(n)}" for n in LEVELS)
    return f"coalesce(try_element_at(map({known}), upper({name})), 'UNKNOWN')"
