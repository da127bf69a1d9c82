"""Entries as JSON records, and the ordered sink."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logspark.functions.times import iso_text
from logspark.session import keeps_scan_order, written_table


def to_payload(entries: DataFrame, *, include_raw: bool = False) -> DataFrame:
    """`file, line_no, payload`: one JSON object per entry.

    A missing time is written as null; `meta` appears only when there is any, `raw` only on request.
    """
    head = F.to_json(
        F.struct(
            iso_text(F.col("ts"), F.col("ts_naive")).alias("timestamp"),
            F.lower("level").alias("level"),
            F.col("message"),
            F.col("line_no"),
        ),
        {"ignoreNullFields": "false"},
    )
    inner = lambda text: F.substring(text, F.lit(2), F.char_length(text) - 2)
    parts = [F.lit("{"), inner(head)]
    meta = F.to_json(F.struct("meta"))
    parts.append(F.when(F.col("meta").isNotNull(), F.concat(F.lit(","), inner(meta))).otherwise(""))
    if include_raw:
        raw = F.to_json(F.struct("raw"))
        parts.append(F.when(F.col("raw").isNotNull(), F.concat(F.lit(","), inner(raw))).otherwise(""))
    more = [c for c in ("split",) if c in entries.columns]
    return entries.select("file", "line_no", F.concat(*parts, F.lit("}")).alias("payload"), *more)


def in_line_order(df: DataFrame) -> DataFrame:
    """Total order by file and line; a range shuffle, so only for the sink."""
    return df.orderBy("file", "line_no")


# More splits than this share no task of a scan: the least a split counts for is a thirty-second of what a task reads.
_SPLITS_A_TASK = 64


def write_entries(entries: DataFrame, path: str, *, format: str = "json", mode: str = "error") -> int:
    """Write entries in line order and return their number, counted by the write itself.

    Payloads written as JSON become one plain JSON object a line, without a field around them.

    Entries with `split` (of lines read with `keep_split`) lie in order inside their splits, so nothing is moved, sorted or
    stored: each split gets a folder `split=<number>`, whose names sort as the files and the places in them do, and
    a task writes its splits side by side. Where a shuffle stands between the scan and here, whole splits are gathered
    again by their number and sorted by line. Entries without `split` take a range shuffle, which reads its input twice, so they
    are stored first.
    """
    seen, plain = Observation(), format == "json" and "payload" in entries.columns
    format = "text" if plain else format
    if "split" not in entries.columns:
        ordered = in_line_order(written_table(entries, "unordered"))
        _observed(ordered.select("payload") if plain else ordered, seen).write.mode(mode).format(format).save(path)
        return seen.get["n"]
    if not keeps_scan_order(entries):
        entries = entries.repartition("split").sortWithinPartitions("split", "line_no")
    kept = ["payload"] if plain else [c for c in entries.columns if c != "split"]
    named = entries.select(*kept, F.lpad(F.col("split").cast("string"), 19, "0").alias("split"))
    with _set(entries.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(_SPLITS_A_TASK)):
        _observed(named, seen).write.mode(mode).format(format).partitionBy("split").save(path)
    return seen.get["n"]


def _observed(df: DataFrame, seen: Observation) -> DataFrame:
    return df.observe(seen, F.count(F.lit(1)).alias("n"))


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for one job."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
