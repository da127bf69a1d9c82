"""Times of whole splits and files: what a window cannot touch is not read, or not parsed, again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime, tzinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators.filters import instant
from logspark.operators.parse import parse_entries
from logspark.operators.sniff import MOST_NAMED
from logspark.operators.window import checked
from logspark.session import prepare, written_table
from logspark.sources.lines import block_index, file_path, line_text, raw_lines, text_files, time_ranges

# Formats whose times are taken while lines are counted, where no other format stands before them in the chain.
_TIMED = ("syslog", "access", "bracket")


def timed_formats(formats: Sequence[str | Callable]) -> list[str]:
    """The formats at the head of a chain whose times are cheap; none where a function could come first."""
    head: list[str] = []
    for name in formats:
        if name not in _TIMED:
            break
        head.append(name)
    return [] if any(callable(f) for f in formats) else head


def with_times(
    raw: DataFrame, text: Column, formats: Sequence[str], *, default_tz: str | tzinfo = UTC, bracket_formats: Sequence[str] = fixed.BRACKET_TIME_FORMATS
) -> DataFrame:
    """Add to raw lines `least, greatest, open`: a line's time, and whether it may have one that is not known here.

    The time is what the chain itself says of a line that its leading formats take. No later format sees such a line. Of the others,
    a line without any sign of a format that holds times (a brace, an equals sign, a tab, CEF) has none. Syslog times
    without a year depend on the day of the question, so they are open.
    """
    kept = [c for c in raw.columns if c != "value"]
    lines = raw.select(*kept, F.col("row").alias("line_no"), text.alias("line"), F.lit("?").alias("_mark"))
    carry = [c for c in kept if c != "file"]
    parsed = parse_entries(lines, list(formats), hit_level="_mark", carry=carry, bracket_formats=bracket_formats)
    line, fmt = F.col("raw"), F.col("fmt")
    signs = F.contains(line, F.lit("{")) | F.contains(line, F.lit("=")) | F.contains(line, F.lit("\t")) | F.startswith(line, F.lit("CEF:"))
    yearless = (fmt == "syslog") & ~line.rlike(r"\A<[0-9]+>[0-9]")
    when = instant(default_tz)
    return parsed.select(*kept, when.alias("least"), when.alias("greatest"), F.when(fmt.isNull(), signs).otherwise(yearless).alias("open"))


def apart(since: datetime | None, until: datetime | None, default_tz: str | tzinfo = UTC) -> Column:
    """Whether no line of a split or file can have a time in the window."""
    since, until = checked(since, until, default_tz)
    outside = F.col("least").isNull()
    if since is not None:
        outside = outside | (F.col("greatest") < F.lit(since))
    if until is not None:
        outside = outside | (F.col("least") >= F.lit(until))
    return (F.col("open") == 0) & outside


def time_zones(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    formats: Sequence[str] = fixed.FORMATS,
    default_tz: str | tzinfo = UTC,
    encoding: str = "utf-8",
    decode_errors: str = "replace",
    line_sep: str | None = None,
    allowed_only: bool = False,
) -> DataFrame:
    """`file, size, least, greatest, open` of files, to be stored and given to later triages as `zones`.

    Takes a scan of the files. A file that has grown or is new is not left out by an older table, nor is one with lines whose
    time the cheap rules do not tell (`open`).
    """
    prepare(spark)
    raw = raw_lines(text_files(spark, paths, encoding, line_sep, allowed_only))
    head = timed_formats(formats)
    if head:
        rows = with_times(raw, line_text(raw, encoding, decode_errors), head, default_tz=default_tz)
    else:
        nothing = F.lit(None).cast("timestamp")
        rows = raw.withColumns({"least": nothing, "greatest": nothing, "open": F.lit(True)})
    blocks = block_index(rows, F.max("size").alias("size"), *time_ranges())
    by_file = blocks.groupBy("file").agg(F.max("size").alias("size"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("open").alias("open"))
    return written_table(by_file, "time-zones")


def left_out(zones: DataFrame, since: datetime | None, until: datetime | None, default_tz: str | tzinfo = UTC) -> Column | None:
    """The condition on a scan's files under which they are read; None where all are."""
    named = F.concat_ws("|", F.col("size").cast("string"), F.col("file")).alias("key")
    found = zones.where(apart(since, until, default_tz)).select(named).limit(MOST_NAMED).toPandas()["key"].tolist()
    key = F.concat_ws("|", F.col("_metadata.file_size").cast("string"), file_path())
    return ~key.isin(found) if found else None
