"""Row filters on lines and entries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import UTC, datetime, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators.window import checked, zone


def parse_levels(names: Sequence[str] | None) -> list[str] | None:
    """Level names as given by a user; blanks are skipped, an all-blank list means no filter."""
    wanted = [name.strip().upper() for name in names or ()]
    unknown = [name for name in wanted if name and name not in fixed.LEVELS]
    if unknown:
        raise ValueError(f"unknown log level {unknown[0]!r}; use any of {', '.join(fixed.ALL_LEVELS)}")
    return [name for name in wanted if name] or None


def effective_levels(
    levels: Sequence[str] | None = None, *, include_all_levels: bool = False, with_review: bool = False
) -> list[str] | None:
    """Levels a triage keeps: the given ones, or the defaults of its mode."""
    if include_all_levels and with_review:
        raise ValueError("include_all_levels cannot be combined with a review")
    if include_all_levels:
        return list(fixed.ALL_LEVELS)
    return parse_levels(levels or (fixed.REVIEW_IDENTIFIED_LEVELS if with_review else fixed.DEFAULT_LEVELS))


def filter_contains(lines: DataFrame, text: str | None) -> DataFrame:
    """Lines that hold a literal text; to be placed before parsing."""
    return lines if text is None else lines.where(F.contains(F.col("line"), F.lit(text)))


def filter_levels(entries: DataFrame, levels: Iterable[str] | None) -> DataFrame:
    """Entries of the given levels; None keeps all, an empty set keeps none."""
    if levels is None:
        return entries
    wanted = list(levels)
    return entries.where(F.col("level").isin(wanted)) if wanted else entries.where(F.lit(False))


def instant(default_tz: str | tzinfo = UTC) -> Column:
    """An entry's time; one without zone is read in `default_tz`."""
    ts = F.col("ts")
    if str(zone(default_tz)) == "UTC":
        return ts
    return F.when(F.col("ts_naive"), F.to_utc_timestamp("ts", str(zone(default_tz)))).otherwise(ts)


def filter_window(
    entries: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    *,
    timestamp_policy: str = "include",
    default_tz: str | tzinfo = UTC,
) -> DataFrame:
    """Entries in [since, until); `timestamp_policy` says whether those without time stay."""
    if timestamp_policy not in ("include", "exclude"):
        raise ValueError("timestamp_policy must be 'include' or 'exclude'")
    since, until = checked(since, until, default_tz)
    ts, inside = instant(default_tz), F.lit(True)
    if since is not None:
        inside = inside & (ts >= F.lit(since))
    if until is not None:
        inside = inside & (ts < F.lit(until))
    if timestamp_policy == "exclude":
        return entries.where(F.col("ts").isNotNull() & inside)
    return entries if since is None and until is None else entries.where(F.col("ts").isNull() | inside)


def exclude_lines(entries: DataFrame, excluded: DataFrame | Iterable[int] | None) -> DataFrame:
    """Lines or entries without the given ones: line numbers for every file, or a `file, line_no` table.

    Placed before the parse it moves lines only, and excluded lines are never parsed. Given numbers become
    a small table, not literals of the plan; Spark broadcasts either table by its size or shuffles.
    """
    if excluded is None:
        return entries
    if isinstance(excluded, DataFrame):
        return entries.join(excluded.select("file", "line_no"), ["file", "line_no"], "left_anti").select(*entries.columns)
    numbers = [(int(n),) for n in excluded]
    if not numbers:
        return entries
    table = entries.sparkSession.createDataFrame(numbers, "line_no bigint")
    return entries.join(table, "line_no", "left_anti").select(*entries.columns)
