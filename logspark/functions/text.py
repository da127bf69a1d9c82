"""Text expressions shared by the parse jobs.

The parse plan is written as SQL expression text: it nests deeply, and one string reaches the JVM in
one call where a Column tree needs thousands.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.fixed import BLANKS, NON_WS, WS


def lit(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def strip(text: str) -> str:
    """Trim Unicode blanks from both ends; looks at the two end characters first."""
    ends = f"substring({text}, 1, 1) IN ({lits(BLANKS)}) OR substring({text}, -1, 1) IN ({lits(BLANKS)})"
    return f"CASE WHEN {ends} THEN btrim({text}, {lit(BLANKS)}) ELSE {text} END"


def unicode_blanks(pattern: str) -> str:
    """A pattern whose `\\s` and `\\S` mean all Unicode blanks, and whose `.` means any character."""
    return "(?sU)" + pattern.replace(r"\s", WS).replace(r"\S", NON_WS)


def layout(pattern: str, *fields: str) -> str:
    """Replacement that lays named groups out as newline-separated fields.

    A field may join groups with `+`: whichever took part in the match supplies the text. An empty
    field stays empty, and a field in quotes stands for itself.
    """
    order = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    text = ""
    for field in fields:
        if field.startswith("'"):
            text += "\n" + field.strip("'")
        else:
            text += "\n" + "".join("$%d" % (order.index(name) + 1) for name in field.split("+") if name)
    return text


def fields_of(text: str, pattern: str, *fields: str) -> str:
    """Match a whole line once and turn it into newline-separated fields.

    Anything that does not match comes back unchanged. A log line never holds a newline, so a leading
    newline means "already recognised".
    """
    return f"regexp_replace({text}, {lit(pattern)}, {lit(layout(pattern, *fields))})"


def any_word(words: Iterable[str]) -> str:
    """One pattern that finds any of the words in one pass: their letters as a tree."""
    tails: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        tails.setdefault(word[0], []).append(word[1:])
    # A word that begins another decides already.
    grown = [re.escape(c) + ("" if "" in rest else any_word(rest)) for c, rest in tails.items()]
    return grown[0] if len(grown) == 1 else "(?:" + "|".join(grown) + ")"


# A line is looked through once for all words where these begin with few characters; the pattern then fails fast elsewhere.
_FEW_BEGINNINGS = 3


def first_match(ladder: dict, hay: str) -> str:
    """Name of the first rung that has a word in `hay`, else NULL."""
    listed = {name: list(words) for name, words in ladder.items()}
    rungs = [
        f"WHEN {' OR '.join(f'contains({hay}, {lit(w)})' for w in words)} THEN {lit(name)}" for name, words in listed.items() if words
    ]
    if not rungs:
        return "CAST(NULL AS STRING)"
    every = [w for words in listed.values() for w in words]
    begin = {w[:1] for w in every}
    if len(every) > 4 and len(begin) <= _FEW_BEGINNINGS and "" not in begin:
        look = "(?=[" + "".join(map(re.escape, sorted(begin))) + "])" + any_word(every)
        rungs.insert(0, f"WHEN NOT {hay} RLIKE {lit(look)} THEN NULL")
    return f"CASE {' '.join(rungs)} END"


def integer_text(text: str) -> str:
    """Canonical decimal text of an integer literal (sign, leading zeros, `_` separators), else NULL."""
    plain = f"replace({text}, '_')"
    size = f"regexp_replace({plain}, {lit(chr(92) + 'A[+-]?0*(?=[0-9])')}, '')"
    return (
        f"CASE WHEN {text} RLIKE {lit(r'\A(?:0|[1-9][0-9]*)\z')} THEN {text} "
        f"WHEN {text} RLIKE {lit(r'\A[+-]?[0-9]+(?:_[0-9]+)*\z')} THEN "
        f"CASE WHEN startswith({text}, '-') AND {size} <> '0' THEN concat('-', {size}) ELSE {size} END END"
    )


def ascii_upper(text: Column) -> Column:
    """Upper-case a-z only, as a byte scan does; non-ASCII letters stay as they are."""
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.upper(text)).otherwise(
        F.translate(text, lower, lower.upper())
    )
