"""One JSON object per line, read through VARIANT so that key presence and value types stay visible."""

from __future__ import annotations

from logspark.fixed import BLANKS, WS
from logspark.functions.text import lit


def looks_like_object(line: str) -> str:
    return f"{line} RLIKE {lit(rf'(?sU)\A{WS}*+\{{.*\}}{WS}*+\z')}"


def json_object(line: str) -> str:
    """VARIANT `[object]`, or NULL. The array brackets refuse text that follows the first value."""
    return f"try_parse_json(concat('[', btrim({line}, {lit(BLANKS)}), ']'))"


def is_single(parsed: str) -> str:
    return f"{parsed} IS NOT NULL AND try_variant_get({parsed}, '$[1]', 'variant') IS NULL"


def first_present(parsed: str, keys) -> str:
    """Value of the first key the object has; a JSON null counts as present."""
    def value(key: str) -> str:
        path = lit("$[0]['%s']" % key.replace("'", "\\'"))
        return f"try_variant_get({parsed}, {path}, 'variant')"

    return f"coalesce({', '.join(value(k) for k in keys)})"


def string_only(value: str) -> str:
    return f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get({value}, '$', 'string') END"


def as_text(value: str) -> str:
    """Text of a value: strings as they are, True/False, numbers, nested values as JSON. NULL for null."""
    kind, plain = f"schema_of_variant({value})", f"try_variant_get({value}, '$', 'string')"
    return f"""
CASE WHEN {kind} IN ('STRING', 'BIGINT') THEN {plain} WHEN {kind} = 'VOID' THEN NULL
     WHEN {kind} = 'BOOLEAN' THEN initcap({plain})
     WHEN {kind} = 'DOUBLE' OR (startswith({kind}, 'DECIMAL') AND contains({plain}, '.'))
     THEN cast(try_variant_get({value}, '$', 'double') AS string)
     WHEN startswith({kind}, 'DECIMAL') THEN {plain} ELSE to_json({value}) END"""
