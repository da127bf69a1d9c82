"""The stateless part of a triage on a stream of lines.

Parsing, level and window filters are plain column work and run on a streaming DataFrame as they
are. Line numbers, format detection and segments need a bounded input and are not offered here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import filters
from logspark.operators.parse import parse_entries
from logspark.session import prepare
from logspark.sources.lines import decoded


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the text files in a folder; `line_no` is NULL."""
    prepare(spark)
    return spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.lit(None).cast("bigint").alias("line_no"),
        F.rtrim(decoded(F.col("value")), F.lit("\r\n")).alias("line"),
    )


def stream_entries(
    lines: DataFrame, *, as_of: datetime, severities=None, contains: str | None = None,
    since: datetime | None = None, until: datetime | None = None, timestamp_policy: str = "include", **options
) -> DataFrame:
    """Entries of streamed lines; `as_of` is fixed so that a replayed batch gives the same rows."""
    out = parse_entries(filters.filter_contains(lines, contains), as_of=as_of, **options)
    out = filters.filter_levels(out, severities)
    return filters.filter_window(out, since, until, timestamp_policy=timestamp_policy)
