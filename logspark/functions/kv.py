"""Key/value fields: how lines become pairs, and how pairs become time, level and message."""

from __future__ import annotations

from logspark.fixed import LEVEL_ALIASES, LEVELS, WS
from logspark.functions.text import lit, strip

# One piece of a shell word: a plain character, an escaped one, or a quoted run.
_PIECE = r"""(?:[^ \t\r\n"'\\]|\\.|"(?:[^"\\]|\\.)*+"|'[^']*+')"""
_WORDS_ONLY = rf"(?s)\A(?:[ \t\r\n]|{_PIECE})*+\z"
_WORD = rf"(?s)({_PIECE}++)"
_UNIT = r"""(?s)([^"'\\]++|\\.|"(?:[^"\\]|\\.)*+"|'[^']*+')"""
_QUOTING = r"""["'\\]"""


def _pairs(words: str, sep: str) -> str:
    """`key<sep>value` words as (k, v); words without the separator or without a key are left out."""
    kept = f"filter({words}, w -> instr(w, {lit(sep)}) > 1)"
    value = f"substring(w, instr(w, {lit(sep)}) + 1)"
    return f"transform({kept}, w -> struct(substring_index(w, {lit(sep)}, 1) AS k, {value} AS v))"


def _unquoted(word: str) -> str:
    """One shell word without its quoting."""
    inner = "substring(u, 2, char_length(u) - 2)"
    unit = (
        "CASE WHEN startswith(u, '\\\\') THEN substring(u, 2, 1) "
        f"WHEN startswith(u, '\\'') THEN {inner} "
        f"WHEN startswith(u, '\"') THEN regexp_replace({inner}, {lit(r'\\(["\\])')}, '$1') ELSE u END"
    )
    units = f"regexp_extract_all({word}, {lit(_UNIT)}, 1)"
    return f"CASE WHEN {word} RLIKE {lit(_QUOTING)} THEN array_join(transform({units}, u -> {unit}), '') ELSE {word} END"


def logfmt_pairs(line: str) -> str:
    """Pairs of a shell-quoted `key=value` line; NULL when the quoting is unbalanced."""
    words = f"transform(regexp_extract_all({line}, {lit(_WORD)}, 1), x -> {_unquoted('x')})"
    return _pairs(
        f"CASE WHEN NOT {line} RLIKE {lit(_QUOTING)} THEN split({line}, {lit(r'[ \t\r\n]+')}) "
        f"WHEN {line} RLIKE {lit(_WORDS_ONLY)} THEN {words} END",
        "=",
    )


def ltsv_pairs(line: str) -> str:
    return _pairs(f"split({line}, '\t')", ":")


def cef_pairs(extension: str) -> str:
    return _pairs(f"split({extension}, {lit('(?U)' + WS + '+')})", "=")


def lower_keys(fields: str) -> str:
    """The map with lower-case keys; of keys that differ only in case, the last value wins."""
    names = f"array_join(map_keys({fields}), ' ')"
    lowered = f"map_from_entries(transform(map_entries({fields}), e -> struct(lower(e.key), e.value)))"
    return f"CASE WHEN {names} = lower({names}) THEN {fields} ELSE {lowered} END"


def _named() -> str:
    known = {**{lv: lv for lv in LEVELS if lv != "UNKNOWN"}, **LEVEL_ALIASES}
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in known.items()) + ")"


def kv_level(fields: str, keys) -> str:
    """First level key that names a level, by name or usual alias."""
    found = [f"try_element_at({fields}, {lit(k)})" for k in keys]
    named = [f"try_element_at({_named()}, upper({strip(f)}))" for f in found]
    return f"coalesce({', '.join(named)}, 'UNKNOWN')"


def kv_message(fields: str, keys) -> str:
    """First message key with a non-empty value."""
    found = [f"try_element_at({fields}, {lit(k)})" for k in keys]
    return "CASE " + " ".join(f"WHEN {f} <> '' THEN {f}" for f in found) + " END"


def kv_values(fields: str, keys) -> str:
    """Values of the keys, in order; NULL for the absent ones."""
    return ", ".join(f"try_element_at({fields}, {lit(k)})" for k in keys)
