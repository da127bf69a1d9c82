"""Log triage on Spark: numbered lines, format detection, parsing, filters and review segments."""

from logspark.operators.filters import (
    effective_levels, exclude_lines, filter_contains, filter_levels, filter_window, parse_levels,
)
from logspark.operators.parse import parse_entries
from logspark.operators.payload import in_line_order, to_payload, write_entries
from logspark.operators.review import (
    dedup_segments, keep_findings, parse_findings, prompts, redact, rejected, review_segments, segments,
    split_entries, stored,
)
from logspark.operators.sniff import read_and_sniff, scan_hits, sniff_formats
from logspark.operators.user import parse_with
from logspark.operators.window import resolve_window
from logspark.operators.zones import time_zones
from logspark.plans.jobs import Review, entries, review_dataset, triage, triage_with_review
from logspark.session import prepare, remove_scratch
from logspark.sources.lines import read_files, read_lines

__all__ = [
    "Review", "dedup_segments", "effective_levels", "entries", "exclude_lines", "filter_contains",
    "filter_levels", "filter_window", "in_line_order", "keep_findings", "parse_entries", "parse_findings",
    "parse_levels", "parse_with", "prepare", "prompts", "read_and_sniff", "read_files", "read_lines", "redact", "rejected",
    "remove_scratch", "resolve_window", "review_dataset", "review_segments", "scan_hits", "segments", "sniff_formats",
    "split_entries", "stored", "time_zones", "to_payload", "triage", "triage_with_review", "write_entries",
]
