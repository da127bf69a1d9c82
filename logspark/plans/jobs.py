"""The user-facing jobs: entries, triage, and the review dataset, from paths to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import UTC, datetime, tzinfo
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from logspark import fixed
from logspark.operators import filters, review
from logspark.operators.parse import ENTRY_SCHEMA, parse_entries
from logspark.operators.sniff import read_and_sniff, scan_hits
from logspark.operators.window import resolve_window
from logspark.operators.zones import apart, left_out, timed_formats, with_times
from logspark.session import prepare, written_table
from logspark.sources.lines import read_lines


class Review(NamedTuple):
    """Result of a triage with review; `findings` is None until a reviewer is given."""

    identified: DataFrame
    segments: DataFrame
    findings: DataFrame | None
    rejected: DataFrame | None


def entries(
    lines: DataFrame,
    *,
    formats: Sequence[str | Callable] = fixed.FORMATS,
    tokens: Mapping[str, Iterable[str]] = fixed.SCAN_TOKENS,
    case_insensitive: bool = True,
    detected: DataFrame | str | None = None,
    hours_lookback: int | None = 24,
    since: datetime | None = None,
    until: datetime | None = None,
    severities: Iterable[str] | None = None,
    contains: str | None = None,
    default_tz: str | tzinfo = UTC,
    fast_prefilter: bool = True,
    timestamp_policy: str = "include",
    sniff_lines: int = fixed.SNIFF_LINES,
    include_raw: bool = True,
    as_of: datetime | None = None,
    **parse_options,
) -> DataFrame:
    """Entries of numbered lines after prefilter, parse and filters.

    `fast_prefilter` looks at candidate lines only, in files whose format is recognised; without it
    every line is parsed. Without `detected`, the formats take a scan of `lines`; lines of files had better
    come with their formats from `read_and_sniff`, as in `triage`.
    """
    prepare(lines.sparkSession)
    if (since is not None or until is not None) and hours_lookback is not None:
        raise ValueError("give a window or hours_lookback, not both")
    as_of = as_of or datetime.now(UTC)
    if hours_lookback is not None:
        since, until = resolve_window(hours_lookback=hours_lookback, as_of=as_of)
    severities = None if severities is None else list(severities)
    if severities == []:  # nothing can be kept: start no job
        more = ", split bigint" if "split" in lines.columns else ""
        nothing = lines.sparkSession.createDataFrame([], ENTRY_SCHEMA + more)
        return nothing if include_raw else nothing.drop("raw")

    # Format detection reads the unfiltered head of each file, so it comes before the text filter.
    level = None
    if fast_prefilter:
        level = "hit_level"
        lines = scan_hits(
            lines, detected, tokens=tokens, case_insensitive=case_insensitive,
            sample_lines=sniff_lines, pass_unknown=True,
        )
    lines = filters.filter_contains(lines, contains)
    carry = [c for c in ("split",) if c in lines.columns]
    out = parse_entries(lines, formats, as_of=as_of, hit_level=level, carry=carry, **parse_options)
    out = filters.filter_levels(out, severities)
    out = filters.filter_window(out, since, until, timestamp_policy=timestamp_policy, default_tz=default_tz)
    return out if include_raw else out.drop("raw")


def triage(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    since: str | None = None,
    until: str | None = None,
    date: str | None = None,
    hour: str | None = None,
    week: str | None = None,
    month: str | None = None,
    year: str | None = None,
    days_lookback: int | None = None,
    hours_lookback: int | None = None,
    levels: Sequence[str] | None = None,
    contains: str | None = None,
    include_raw: bool = False,
    include_all_levels: bool = False,
    include_review: bool = False,
    reviewer: Callable[[str], str] | None = None,
    as_of: datetime | None = None,
    encoding: str = "utf-8",
    decode_errors: str = "replace",
    line_sep: str | None = None,
    allowed_only: bool = False,
    keep_split: bool = False,
    zones: DataFrame | None = None,
    **options,
) -> DataFrame | Review:
    """Triage log files: the entries of a time window and a set of levels.

    Without any window the last 24 hours count. With `include_review` the result is a `Review`. `encoding`,
    `decode_errors`, `line_sep` and `allowed_only` go to `read_lines`, other options to the job. `keep_split` adds the column
    by which `write_entries` keeps line order without a shuffle.

    With `timestamp_policy="exclude"` the counting scan notes the range of times in every split, and what lies apart from the window
    is neither parsed nor, file by file, read again. `zones`, a stored table of `time_zones`, leaves such files out from the
    first scan on. Lines whose time the cheap rules do not tell keep their split.
    """
    as_of = as_of or datetime.now(UTC)
    wanted = filters.effective_levels(levels, include_all_levels=include_all_levels, with_review=include_review)
    start, end = resolve_window(
        since=since, until=until, date=date, hour=hour, week=week, month=month, year=year,
        days_lookback=days_lookback, hours_lookback=hours_lookback, as_of=as_of,
    )
    lookback = 24 if start is None and end is None else None
    window = dict(since=start, until=end, hours_lookback=lookback, contains=contains, as_of=as_of)
    reading = dict(encoding=encoding, decode_errors=decode_errors, line_sep=line_sep, allowed_only=allowed_only, keep_split=keep_split or include_review)
    sniffing = not include_review and options.get("fast_prefilter", True) and options.get("detected") is None
    head = timed_formats(options.get("formats", fixed.FORMATS))
    if options.get("timestamp_policy") == "exclude" and head:
        tz = options.get("default_tz", UTC)
        low, high = (start, end) if lookback is None else resolve_window(hours_lookback=lookback, as_of=as_of)
        own = {k: options[k] for k in ("bracket_formats",) if k in options}
        lines, found = read_and_sniff(
            spark, paths, options.get("sniff_lines", fixed.SNIFF_LINES), **reading, closed=apart(low, high, tz),
            only=None if zones is None else left_out(zones, low, high, tz),
            times=lambda raw, text: with_times(raw, text, head, default_tz=tz, **own), sniff=sniffing,
        )
        if sniffing:
            options["detected"] = found
    elif sniffing:
        lines, options["detected"] = read_and_sniff(spark, paths, options.get("sniff_lines", fixed.SNIFF_LINES), **reading)
    else:
        lines = read_lines(spark, paths, **reading)
    if include_review:
        return triage_with_review(
            lines, identified_levels=wanted or (), reviewer=reviewer,
            include_raw=include_raw, **window, **options,
        )
    return entries(lines, severities=wanted, include_raw=include_raw, **window, **options)


def _review_entries(lines: DataFrame, identified: Iterable[str], excluded, **options) -> DataFrame:
    lines = filters.exclude_lines(lines, excluded)
    return entries(lines, severities=review.wanted_levels(identified), fast_prefilter=False, include_raw=True, **options)


def review_dataset(
    lines: DataFrame,
    *,
    exclude: DataFrame | Iterable[int] | None = None,
    identified_levels: Iterable[str] = fixed.REVIEW_IDENTIFIED_LEVELS,
    segment_max_lines: int = fixed.SEGMENT_LINES,
    redact: bool = True,
    hours_lookback: int | None = None,
    **options,
) -> DataFrame:
    """Segments, with prompts, of the entries that carry no identified level.

    The review entries and the segments are written once to the shared folder, so that no line is parsed, and no text
    masked or hashed, twice. Lines read with `keep_split` become segments where they are stored, without a shuffle of texts.
    """
    identified = list(identified_levels)
    found = _review_entries(lines, identified, exclude, hours_lookback=hours_lookback, **options)
    _, rest = review.split_entries(found, identified)
    rest = review.stored(rest.drop("fmt", "raw", "meta"), "review-entries")
    segments = _written_segments(rest, max_lines=segment_max_lines, redacted=redact)
    return review.prompts(review.dedup_segments(segments), identified)


def _written_segments(rest: DataFrame, **options) -> DataFrame:
    """Segments as a table; those built in scan order are stored already."""
    found = review.segments(rest, **options)
    return found if "split" in rest.columns else written_table(found, "segments")


def triage_with_review(
    lines: DataFrame,
    *,
    exclude: DataFrame | Iterable[int] | None = None,
    identified_levels: Iterable[str] = fixed.REVIEW_IDENTIFIED_LEVELS,
    segment_max_lines: int = fixed.SEGMENT_LINES,
    redact: bool = True,
    min_confidence: float = fixed.MIN_CONFIDENCE,
    reviewer: Callable[[str], str] | None = None,
    concurrency: int | None = None,
    retries: int = 0,
    pause: float = fixed.REVIEW_PAUSE,
    answers: str | None = None,
    hours_lookback: int | None = None,
    include_raw: bool = True,
    **options,
) -> Review:
    """Identified entries, review segments with prompts and, given a reviewer, its findings.

    The parsed entries and the segments are written once to the shared folder and read from there, and a
    reviewer's answers are stored before they are checked, so no line is parsed and no segment
    reviewed twice. `answers` names a folder that keeps them for later jobs, too (see `review_segments`).
    """
    identified = list(identified_levels)
    found = _review_entries(lines, identified, exclude, hours_lookback=hours_lookback, **options)
    found = review.stored(found if include_raw else found.drop("raw"), "entries")
    known, rest = review.split_entries(found, identified)
    known = known.drop("split")
    segments = _written_segments(rest, max_lines=segment_max_lines, redacted=redact)
    segments = review.prompts(review.dedup_segments(segments), identified)
    if reviewer is None:
        return Review(known, segments, None, None)
    replies = review.review_segments(segments, reviewer, concurrency=concurrency, retries=retries, pause=pause, answers=answers)
    replies = written_table(replies, "responses")
    parsed = review.parse_findings(replies)
    kept = review.keep_findings(parsed, min_confidence=min_confidence)
    return Review(known, segments, kept, review.rejected(replies, parsed))
