"""The `events` table written out as log lines.

Every rendering is one SQL expression over the table's columns, so the expected fields of a line are
known from the columns and the checks need not read the line back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import prepare, scratch_dir

# Events per rendered file and event type; keeps a file's writer bounded at any scale.
FILE_EVENTS = 1_000_000

_BASE = """
SELECT event_id, event_type, user_id, cast(round(value * 100) AS bigint) AS cents, t, part,
  CASE user_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING'
                   WHEN 3 THEN 'INFO' ELSE 'DEBUG' END AS lvl,
  CASE user_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 7 END AS sev,
  'web' || (user_id % 7) AS host, 'user ' || user_id || ' paid ' || cast(round(value * 100) AS bigint) AS msg,
  date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS us, date_format(t, 'yyyy-MM-dd HH:mm:ss') AS sec
FROM {events}
"""

LINE = {
    "syslog5424": "'<' || (8 * (user_id % 24) + sev) || '>1 ' || us || 'Z ' || host || ' ' || event_type || ' 77 ID'"
    " || event_id || CASE WHEN event_id % 3 = 0 THEN ' [meta seq=\"1\"] ' ELSE ' - ' END || msg",
    "syslog3164": "'<' || (8 * (user_id % 24) + sev) || '>' || date_format(t, 'MMM') || ' ' || lpad(day(t), 2, ' ') || ' '"
    " || date_format(t, 'HH:mm:ss') || ' ' || host || ' ' || event_type || '[77]: ' || msg",
    "access": "'10.0.' || (user_id % 250) || '.7 - u' || user_id || ' [' || date_format(t + INTERVAL 90 MINUTES, 'dd/MMM/yyyy:HH:mm:ss')"
    " || ' +0130] \"GET /' || event_type || '/' || event_id || ' HTTP/1.1\" '"
    " || CASE user_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 200 ELSE 301 END || ' '"
    " || CASE WHEN event_id % 7 = 0 THEN '-' ELSE cast(cents AS string) END || ' \"-\" \"agent/1.0\"'",
    "bracket": "sec || ' [' || lvl || '] ' || msg",
    "bracket5": "CASE event_id % 5 WHEN 0 THEN sec WHEN 1 THEN replace(sec, ' ', 'T') WHEN 2 THEN replace(sec, ' ', 'T') || 'Z'"
    " WHEN 3 THEN replace(sec, '-', '/') ELSE date_format(t, 'dd-MM-yyyy HH:mm:ss') END"
    " || ' [' || CASE WHEN event_id % 11 = 0 THEN 'NOTICE' ELSE lower(lvl) END || ']   ' || msg || '  '",
    "jsonl": "CASE event_id % 4 WHEN 0 THEN '{\"timestamp\":\"' || us || 'Z\",\"level\":\"' || lower(lvl) || '\",\"message\":\"' || msg || '\"}'"
    " WHEN 1 THEN '{\"ts\":\"' || us || '+01:30\", \"level\":\"' || lower(lvl) || '\", \"msg\":' || cents || '}'"
    " WHEN 2 THEN '  {\"time\":\"' || us || '\", \"severity\":\"' || lvl || '\", \"detail\":\"a \\\\\"b\\\\\" ' || event_id || '\"}'"
    " ELSE '{\"timestamp\":null,\"ts\":\"' || us || '\",\"lvl\":\"warn\",\"id\":' || event_id || '}' END",
    "cef": "'CEF:0|Acme|Gate|1.' || (user_id % 3) || '|' || event_id || '|' || event_type || ' seen|'"
    " || CASE user_id % 5 WHEN 0 THEN '10' WHEN 1 THEN '8' WHEN 2 THEN '5' WHEN 3 THEN '2' ELSE 'High' END || '|src=10.0.0.'"
    " || (user_id % 250) || ' rt=' || unix_millis(t) || CASE WHEN event_id % 2 = 0 THEN ' msg=done_' || cents ELSE '' END",
    "logfmt": "CASE WHEN event_id % 2 = 0 THEN 'time=' || us || 'Z level=' || lower(lvl) || ' msg=\"' || msg || ' \\\\\"ok\\\\\"\" id=' || event_id"
    " ELSE 'ts=soon Level=none @timestamp=' || us || ' severity=crit id=1 id=' || event_id END",
    "ltsv": "'time:' || us || 'Z\\tlevel:' || lower(lvl) || '\\thost:' || host || '\\t' || CASE WHEN event_id % 2 = 0 THEN 'msg:' || msg ELSE 'note:' || msg END",
    "loose": "CASE user_id % 5 WHEN 0 THEN 'kernel panic at' WHEN 1 THEN 'Traceback in' WHEN 2 THEN 'timeout of' WHEN 3 THEN 'information on'"
    " ELSE 'trace of' END || ' step ' || event_id || ' for user ' || user_id",
    "tokens": "'svc ' || CASE user_id % 5 WHEN 0 THEN 'Fatal stop' WHEN 1 THEN 'call failed' WHEN 2 THEN 'warn low disk' WHEN 3 THEN 'Info ping' ELSE 'nothing new' END"
    " || ' id ' || event_id",
    "fallback": "CASE WHEN event_id % 2 = 0 THEN sec || ' [' || lvl || '] ' || msg"
    " WHEN user_id % 5 = 0 THEN 'disk SEVERE wear on ' || host WHEN user_id % 5 = 1 THEN 'job FAILURE on ' || host"
    " WHEN user_id % 5 = 2 THEN 'call DEPRECATED on ' || host ELSE 'plain note on ' || host END",
}
CHAIN = ("syslog5424", "access", "bracket5", "jsonl", "cef", "logfmt", "ltsv", "loose")
LINE["chain"] = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {LINE[n]}" for i, n in enumerate(CHAIN)) + " END"
LINE["payload"] = f"CASE event_id % 3 WHEN 0 THEN {LINE['bracket']} WHEN 1 THEN {LINE['logfmt']} ELSE {LINE['loose']} END"
# Written as latin-1, the first character is the byte that cp1252 reads as a euro sign.
LINE["charset"] = "char(128) || ' ' || host || ' naïve ' || msg"
# Characters of two bytes, one of which ends in a backslash in shift_jis.
LINE["wide_charset"] = "host || ' 表示 ソ ' || msg"
# One format per event type, so that every rendered file has one.
LINE["by_type"] = (
    f"CASE event_type WHEN 'view' THEN {LINE['access']} WHEN 'click' THEN {LINE['syslog5424']} "
    f"WHEN 'purchase' THEN {LINE['jsonl']} WHEN 'error' THEN {LINE['bracket']} ELSE {LINE['tokens']} END"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the values the renderings use."""
    prepare(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "event_type", "user_id", "value", F.col("ts").cast("timestamp").alias("t"),
        F.floor(F.col("event_id") / FILE_EVENTS).alias("part"),
    )
    return spark.sql(_BASE, events=raw)


def spread(df: DataFrame) -> DataFrame:
    """A table stored in fewer pieces than there are cores, spread over them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rendered lines without a detour over files; the event id is the line number."""
    return spread(events(spark, sf_dir)).select(
        F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.expr(LINE[name]).alias("line")
    )


_written: dict[tuple, str] = {}


def files(spark: SparkSession, sf_dir: str, name: str, compression: str = "none", charset: str | None = None) -> str:
    """Folder of rendered log files, one per event type and million events, in event order.

    Spark's text sink writes UTF-8 only; another charset goes through the CSV sink, for lines that need no quotes.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, compression, charset)
    if key not in _written:
        path = f"{scratch_dir(spark)}/logs-{name}-{uuid.uuid4().hex}"
        sink = (
            events(spark, sf_dir)
            .select("event_type", "part", "event_id", F.expr(LINE[name]).alias("value"))
            .repartition("event_type", "part")
            .sortWithinPartitions("event_type", "part", "event_id")
            .drop("event_id")
            .write.partitionBy("event_type", "part")
            .option("compression", compression)
        )
        if charset is None:
            sink.text(path)
        else:
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # the sink's own list has UTF and latin-1 only
            try:
                sink.option("encoding", charset).csv(path)
            finally:
                spark.conf.unset("spark.sql.legacy.javaCharsets")
        _written[key] = path
    return _written[key]


@contextmanager
def many_splits(spark: SparkSession, path: str) -> Iterator[str]:
    """While it lasts, the files of a folder are read in some thirty splits or more, whatever their size."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    wanted = {"spark.sql.files.maxPartitionBytes": str(max(4096, size // 32)), "spark.sql.files.openCostInBytes": "512"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield path
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def file_key(column: str = "file") -> Column:
    """`type/part` of a rendered file's path."""
    return F.regexp_replace(column, r"^.*/event_type=([^/]+)/part=([^/]+)/.*$", "$1/$2")
