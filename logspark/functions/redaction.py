"""Masking of personal data and secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.fixed import REDACTIONS

# A text a pattern cannot match without, by mask; several patterns may share one.
_NEEDS = {"<REDACTED_JWT>": ("eyJ", "."), "<REDACTED_EMAIL>": ("@", "."), "<REDACTED_TOKEN>": ()}

# Runs of these characters are tried once, from the first place where a match could start: any later
# start would end at the same character after the run. The part skipped is put back.
_RUNS = {
    "<REDACTED_JWT>": ("[a-zA-Z0-9_-]", r"\beyJ[a-zA-Z0-9_-]{10,}", r"\b(?=eyJ)", r"eyJ[a-zA-Z0-9_-]{10,}+"),
    "<REDACTED_EMAIL>": ("[A-Z0-9._%+-]", r"\b[A-Z0-9._%+-]+@", r"\b", r"[A-Z0-9._%+-]++@"),
}


def once_a_run(pattern: str, mask: str) -> tuple[str, str]:
    """A pattern that gives the same result without starting again inside a run, and its replacement."""
    if mask not in _RUNS:
        return pattern, mask
    letter, start, border, rest = _RUNS[mask]
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix(flag)
    assert body.startswith(start), body
    return f"{flag}(?:\\G|(?<!{letter}))((?>{letter}*?{border})){rest}" + body.removeprefix(start), "$1" + mask


def redact_text(text: Column) -> Column:
    """Mask tokens, addresses and long keys, in that fixed order, in time linear in the text's length."""
    for plain, mask in REDACTIONS:
        pattern, put = once_a_run(plain, mask)
        needs = _NEEDS.get(mask, (":",) if ":" in plain.replace("(?:", "") else (".",))
        new = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(put))
        due = F.lit(True)
        for part in needs:
            due = due & F.contains(text, F.lit(part))
        text = F.when(due, new).otherwise(text) if needs else new
    return text
