"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import logspark as ls
from catalog import render
from logspark.fixed import FORMATS
from logspark.functions.times import iso_text
from logspark.session import scratch_dir, written_table

AS_OF = datetime(2024, 1, 15, 12, tzinfo=UTC)
WINDOWS = {
    "window_date": dict(date="2024-01-05"),
    "window_hour": dict(hour="2024-01-05T13"),
    "window_week": dict(week="2024-W02"),
    "window_month": dict(month="2024-01", date=""),
    "window_year": dict(year="2024"),
    "window_lookback": dict(hours_lookback=36),
    "window_since_until": dict(since="2024-01-03T04:05:06+02:00", until="2024-01-09"),
}
META = {
    "syslog": ("pri", "severity", "facility", "host", "app"),
    "cef": ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"),
}


def fields(entries: DataFrame) -> DataFrame:
    """Entry columns in comparable form."""
    return entries.select(
        F.col("line_no").alias("event_id"), "fmt", iso_text(F.col("ts"), F.col("ts_naive")).alias("ts"),
        "level", "message", "meta",
    )


def _parsed(name: str, *formats: str, meta: str | None = None) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fields(ls.parse_entries(render.lines(spark, sf_dir, name), formats, as_of=AS_OF))
        if meta in META:
            cols = [F.col(f"meta.{meta}.{c}").cast("string").alias(f"m_{c}") for c in META[meta]]
            if meta == "cef":
                cols.append(F.to_json("meta.cef.extension").alias("m_extension"))
            return out.select("*", *cols).drop("meta")
        if meta is not None:
            return out.withColumn("meta", F.to_json(f"meta.{meta}"))
        return out.drop("meta")

    return query


def lines_numbered(spark, sf_dir):
    found = ls.read_lines(spark, render.files(spark, sf_dir, "bracket"))
    return found.select(render.file_key().alias("file"), "line_no", "line")


def lines_gzip(spark, sf_dir):
    found = ls.read_lines(spark, render.files(spark, sf_dir, "bracket", "gzip"))
    return found.select(render.file_key().alias("file"), "line_no", "line")


def whole_files(spark, sf_dir):
    found = ls.read_files(spark, render.files(spark, sf_dir, "bracket"), allowed_only=True)
    return found.select(render.file_key().alias("file"), "text")


def _charset(*written: str, name: str = "charset", **options) -> Callable:
    def query(spark, sf_dir):
        found = ls.read_lines(spark, [f"{render.files(spark, sf_dir, name, charset=w)}/*/*" for w in written], **options)
        return found.select(render.file_key().alias("file"), "line_no", "line")

    return query


def suffix_allowlist(spark, sf_dir):
    """Text files and files of a suffix that is not allowed, read together."""
    folders = [render.files(spark, sf_dir, "bracket"), render.files(spark, sf_dir, "charset", charset="iso-8859-1")]
    found = ls.read_lines(spark, [f"{folder}/*/*" for folder in folders], allowed_only=True)
    return found.select(render.file_key().alias("file"), "line_no", "line")


def own_tokens(spark, sf_dir):
    """The prefilter with a caller's token table, in any letter case and in the given one."""
    lines = render.lines(spark, sf_dir, "tokens")
    tokens = {"ERROR": ["FAILED"], "INFO": ["Info"]}
    any_case = ls.scan_hits(lines, "unknown", tokens=tokens).withColumn("as_given", F.lit(False))
    as_given = ls.scan_hits(lines, "unknown", tokens=tokens, case_insensitive=False).withColumn("as_given", F.lit(True))
    return any_case.unionByName(as_given).select(F.col("line_no").alias("event_id"), "as_given", "hit_level")


def default_lookback(spark, sf_dir):
    """No window given: the 24 hours before `as_of`."""
    found = ls.entries(render.lines(spark, sf_dir, "bracket"), formats=["bracket"], fast_prefilter=False, as_of=AS_OF)
    return fields(found).select("event_id", "ts", "level", "message")


def sniff_formats(spark, sf_dir):
    found = ls.sniff_formats(ls.read_lines(spark, render.files(spark, sf_dir, "by_type")))
    return found.select(render.file_key().alias("file"), "detected")


def read_and_sniff(spark, sf_dir):
    """Formats found while the lines are counted, and the candidate lines they lead to."""
    lines, found = ls.read_and_sniff(spark, render.files(spark, sf_dir, "by_type"))
    hits = ls.scan_hits(lines, found).groupBy("file").agg(F.count("*").alias("hits"))
    found = found.join(hits, "file", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return found.select(render.file_key().alias("file"), "detected", "hits")


def _hits(name: str, detected: str) -> Callable:
    def query(spark, sf_dir):
        found = ls.scan_hits(render.lines(spark, sf_dir, name), detected)
        return found.select(F.col("line_no").alias("event_id"), "hit_level")

    return query


def scan_hits(spark, sf_dir):
    found = ls.scan_hits(ls.read_lines(spark, render.files(spark, sf_dir, "by_type")))
    return found.select(render.file_key().alias("file"), "line_no", "hit_level")


def _on_files(name: str, **options) -> Callable:
    def query(spark, sf_dir):
        found = ls.entries(ls.read_lines(spark, render.files(spark, sf_dir, name)), as_of=AS_OF, **options)
        return found.select(
            render.file_key().alias("file"), "line_no", "fmt",
            iso_text(F.col("ts"), F.col("ts_naive")).alias("ts"), "level", "message",
        )

    return query


def _window(selectors: dict) -> Callable:
    def query(spark, sf_dir):
        parsed = ls.parse_entries(render.lines(spark, sf_dir, "bracket"), ["bracket"])
        since, until = ls.resolve_window(as_of=AS_OF, **selectors)
        return fields(ls.filter_window(parsed, since, until)).select("event_id", "ts", "level", "message")

    return query


def default_zone(spark, sf_dir):
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "jsonl"), ["jsonl"])
    kept = ls.filter_window(parsed, datetime(2024, 1, 3), datetime(2024, 1, 9), default_tz="America/New_York")
    return fields(kept).select("event_id", "ts")


def no_timestamp_policy(spark, sf_dir):
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "chain"), as_of=AS_OF)
    since, until = ls.resolve_window(week="2024-W02")
    kept = ls.filter_window(parsed, since, until, timestamp_policy="exclude")
    return fields(kept).select("event_id", "fmt", "level")


def levels(spark, sf_dir):
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "chain"), as_of=AS_OF)
    return fields(ls.filter_levels(parsed, ls.parse_levels([" error", "Critical", ""]))).select("event_id", "fmt", "level")


def contains(spark, sf_dir):
    kept = ls.filter_contains(render.lines(spark, sf_dir, "bracket"), "paid 12")
    return fields(ls.parse_entries(kept, ["bracket"])).select("event_id", "level", "message")


def exclude_lines(spark, sf_dir):
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "bracket"), ["bracket"])
    seen = render.events(spark, sf_dir).where("cents > 1000").select(
        F.col("event_type").alias("file"), F.col("event_id").alias("line_no")
    )
    return fields(ls.exclude_lines(parsed, seen)).select("event_id", "level", "message")


def payload(spark, sf_dir):
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "payload"), as_of=AS_OF)
    return ls.to_payload(parsed, include_raw=False).select(F.col("line_no").alias("event_id"), "payload")


def written_entries(spark, sf_dir):
    """The ordered sink over files of many splits, read back: the place of a row among the written ones follows file and line."""
    path = f"{scratch_dir(spark)}/out-{uuid.uuid4().hex}"
    with render.many_splits(spark, render.files(spark, sf_dir, "bracket")) as logs:
        lines = ls.read_lines(spark, logs, keep_split=True)
        found = ls.parse_entries(lines, ["bracket"], carry=["split"]).select("file", "line_no", "level", "message", "split")
        n = ls.write_entries(found, path, format="parquet")
    place = F.struct(F.col("split").cast("bigint"), F.col("_metadata.row_index"))
    written = spark.read.parquet(path).select(render.file_key().alias("file"), "line_no", "level", "message", place.alias("place"))
    behind = F.lag("place").over(Window.partitionBy("file").orderBy("line_no"))
    in_order = F.coalesce(F.col("place") > behind, F.lit(True))
    return written.select("file", "line_no", "level", "message", in_order.alias("in_order"), F.lit(n).alias("n_written"))


def written_payload(spark, sf_dir):
    """The sink's files read back as text: one plain JSON object a line."""
    path = f"{scratch_dir(spark)}/out-{uuid.uuid4().hex}"
    parsed = ls.parse_entries(render.lines(spark, sf_dir, "payload"), as_of=AS_OF)
    ls.write_entries(ls.to_payload(parsed), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.line_no").cast("bigint").alias("event_id"), F.col("value").alias("payload"))


def exclude_before_parse(spark, sf_dir):
    """Lines left out before the parse, as a table."""
    lines = render.lines(spark, sf_dir, "bracket")
    kept = ls.exclude_lines(lines, lines.where("line_no % 50 = 7").select("file", "line_no"))
    return fields(ls.parse_entries(kept, ["bracket"])).select("event_id", "level", "message")


def reviewer_failures(spark, sf_dir):
    """A reviewer that fails on some segments: those are set aside with their error, the others stay."""

    def reviewer(prompt: str) -> str:
        if int(re.search(r"LOG LINES:\n(\d+) ", prompt).group(1)) % 3 == 1:
            raise RuntimeError("no answer")
        return '{"findings": []}'

    asked = ls.prompts(_segments(spark, sf_dir))
    answers = written_table(ls.review_segments(asked, reviewer, retries=1, pause=0), "responses")
    out = ls.rejected(answers, ls.parse_findings(answers))
    return out.select(render.file_key().alias("file"), "segment_id", "error")


def redact_documents(spark, sf_dir):
    ls.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = render.spread(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return ls.redact(rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text"))


def _segments(spark, sf_dir):
    """Segments of files, built where the stored review entries lie."""
    lines = ls.read_lines(spark, render.files(spark, sf_dir, "bracket"), keep_split=True)
    _, rest = ls.split_entries(ls.parse_entries(lines, ["bracket"], carry=["split"]))
    return ls.segments(ls.stored(rest.drop("raw", "meta"), "review-entries"))


def _segment_columns(found: DataFrame, *more: str) -> DataFrame:
    return found.select(
        render.file_key().alias("file"), "segment_id", "first_line", "last_line", "n_lines", "text_sha256", *more
    )


def segments(spark, sf_dir):
    return _segment_columns(_segments(spark, sf_dir), "text")


def segments_many_splits(spark, sf_dir):
    """Files of many splits: most segments lie in one of them, some are cut by a border."""
    with render.many_splits(spark, render.files(spark, sf_dir, "bracket")):
        return _segment_columns(_segments(spark, sf_dir), "text")


def segments_dedup(spark, sf_dir):
    """Segments of seven sources with short texts, many of them equal, regarded as one file."""
    lines = render.events(spark, sf_dir).select(
        F.concat(F.lit("source "), F.col("event_id") % 7).alias("file"), F.expr("event_id div 7 + 1").alias("line_no"),
        F.expr("'[' || lvl || '] step'").alias("message"), F.lit("INFO").alias("level"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("boolean").alias("ts_naive"),
    )
    found = ls.segments(lines, max_lines=2)
    number = F.col("segment_id") * 7 + F.substring("file", 8, 1).cast("bigint")
    one = written_table(found.withColumns({"segment_id": number, "file": F.lit("all")}), "segments")
    return ls.dedup_segments(one).select("segment_id", "n_lines", "text")


def prompts(spark, sf_dir):
    return _segment_columns(ls.prompts(_segments(spark, sf_dir)), "prompt")


def _reviewer() -> Callable[[str], str]:
    """A stand-in reviewer: one finding per segment, as sure as its first line number says."""

    def review(prompt: str) -> str:
        first = int(re.search(r"LOG LINES:\n(\d+) ", prompt).group(1))
        finding = {
            "line_numbers": [first], "severity_guess": ("low", "medium", "high")[first % 3],
            "confidence": (first % 100) / 100, "title": f"line {first}", "rationale": "seen", "recommendation": "look",
        }
        return json.dumps({"findings": [finding]})

    return review


def _finding_columns(found: DataFrame, *keys) -> DataFrame:
    return found.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"),
        "severity_guess", "confidence", "title", "rationale", "recommendation",
    )


def review_fn(spark, sf_dir):
    asked = ls.prompts(_segments(spark, sf_dir))
    found = ls.keep_findings(ls.parse_findings(ls.review_segments(asked, _reviewer(), concurrency=8)))
    return _finding_columns(found, render.file_key().alias("file"), "segment_id")


def stored_answers(spark, sf_dir):
    """Answers kept in a folder: a second job finds them all, so its reviewer, which would fail, is not called."""

    def silent(prompt: str) -> str:
        raise RuntimeError("asked again")

    asked = written_table(ls.prompts(_segments(spark, sf_dir)), "asked")
    path = f"{scratch_dir(spark)}/answers-{uuid.uuid4().hex}"
    ls.review_segments(asked, _reviewer(), answers=path, batch=50)
    again = ls.review_segments(asked, silent, answers=path)
    return _finding_columns(ls.keep_findings(ls.parse_findings(again)), render.file_key().alias("file"), "segment_id")


_RESPONSE = """
CASE event_id % 10 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"findings":[]}}' WHEN 2 THEN '{{}}' ELSE
'{{"findings":[{{"line_numbers":[' || event_id || ',' || (event_id + 1) || '],"severity_guess":"'
|| CASE WHEN event_id % 10 = 3 THEN 'huge' ELSE 'high' END || '","confidence":'
|| CASE WHEN event_id % 10 = 4 THEN '1.5' ELSE '0.' || lpad(cast(cents % 100 AS string), 2, '0') END
|| CASE WHEN event_id % 10 = 5 THEN ',"title":7' ELSE ',"title":"t ' || user_id || '"' END
|| ',"rationale":"r","recommendation":"c","extra":1}},{{"line_numbers":[],"severity_guess":"low","confidence":0.55,"title":"x","rationale":"y","recommendation":"z"}}]}}' END
""".replace("{{", "{").replace("}}", "}")


def _responses(spark, sf_dir):
    return render.spread(render.events(spark, sf_dir)).select(
        F.col("event_type").alias("file"), F.col("event_id").alias("segment_id"), F.expr(_RESPONSE).alias("response")
    )


def findings(spark, sf_dir):
    found = ls.keep_findings(ls.parse_findings(_responses(spark, sf_dir)))
    return _finding_columns(found, F.col("segment_id").alias("event_id"))


def findings_rejected(spark, sf_dir):
    responses = _responses(spark, sf_dir)
    return ls.rejected(responses, ls.parse_findings(responses)).select(F.col("segment_id").alias("event_id"))


def _tokens_parser() -> Callable:
    def svc(line_no: int, line: str):
        words = line.split(" ")
        if words[0] != "svc" or words[1] == "nothing":
            return None
        return {
            "ts": datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=int(words[-1])), "level": "ERROR" if words[1] == "call" else "INFO",
            "message": " ".join(words[1:]), "meta": {"logfmt": {"id": words[-1]}},
        }

    return svc


def user_parser(spark, sf_dir):
    found = ls.parse_with(render.lines(spark, sf_dir, "tokens"), _tokens_parser(), fmt="svc")
    return fields(found).withColumn("meta", F.to_json("meta.logfmt"))


def user_chain(spark, sf_dir):
    """A user parser between built-in formats: it sees only what they left."""
    found = ls.parse_entries(render.lines(spark, sf_dir, "by_type"), ["syslog", "access", _tokens_parser(), "bracket", "jsonl"], as_of=AS_OF)
    return fields(found).withColumn("meta", F.to_json("meta.logfmt"))


def own_tables(spark, sf_dir):
    """A caller's own keys, words and time notations in place of the default ones."""
    logfmt = ls.parse_entries(render.lines(spark, sf_dir, "logfmt"), ["logfmt"], kv_time_keys=["@timestamp"], kv_level_keys=["severity"], kv_message_keys=["id"])
    jsonl = ls.parse_entries(render.lines(spark, sf_dir, "jsonl"), ["jsonl"], json_time_keys=["time"], json_level_keys=["severity"], json_message_keys=["detail", "id"])
    bracket = ls.parse_entries(render.lines(spark, sf_dir, "bracket5"), ["bracket"], bracket_formats=["%Y/%m/%d %H:%M:%S"])
    loose = ls.parse_entries(render.lines(spark, sf_dir, "loose"), ["loose"], keywords={"ERROR": ["PANIC"], "INFO": ["USER 1", "TRACE "]})
    return fields(logfmt.unionByName(jsonl).unionByName(bracket).unionByName(loose)).drop("meta")


def missing_files(spark, sf_dir):
    """What reading says of each rendered file's neighbour that is not there."""
    found = spark.read.text(render.files(spark, sf_dir, "bracket")).select(F.col("_metadata.file_path").alias("file")).groupBy("file").count()
    rows = []
    for row in found.orderBy("file").toLocalIterator():
        try:
            ls.read_lines(spark, row["file"] + ".gone")
            rows.append((row["file"], row["count"], None))
        except AnalysisException as exc:
            rows.append((row["file"], row["count"], exc.getCondition()))
    return spark.createDataFrame(rows, "file string, n_lines bigint, error string").select(render.file_key().alias("file"), "n_lines", "error")


def _triage_columns(found: DataFrame) -> DataFrame:
    return found.select(
        render.file_key().alias("file"), "line_no", iso_text(F.col("ts"), F.col("ts_naive")).alias("ts"), "level", "message"
    )


def triage(spark, sf_dir):
    """The default levels of one day, over bracketed log files."""
    return _triage_columns(ls.triage(spark, render.files(spark, sf_dir, "bracket"), date="2024-01-05"))


def triage_skipping(spark, sf_dir):
    """The same with entries without a time left out: splits apart from the day are not parsed."""
    with render.many_splits(spark, render.files(spark, sf_dir, "bracket")) as logs:
        found = _triage_columns(ls.triage(spark, logs, date="2024-01-05", timestamp_policy="exclude"))
        return written_table(found, "triage")


def time_zones(spark, sf_dir):
    """The range of times in each file of one format, and how many lines may have another."""
    found = ls.time_zones(spark, render.files(spark, sf_dir, "by_type"))
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("least", "greatest")]
    return found.select(render.file_key().alias("file"), *times, "open")


def triage_full(spark, sf_dir):
    """All levels of one week that hold a text, without the prefilter, over files of several formats."""
    found = ls.triage(
        spark, render.files(spark, sf_dir, "by_type"), week="2024-W02", include_all_levels=True, contains="1",
        fast_prefilter=False, as_of=AS_OF, include_raw=True,
    )
    return _triage_columns(found)


def review_dataset(spark, sf_dir):
    lines = ls.read_lines(spark, render.files(spark, sf_dir, "bracket"))
    since, until = ls.resolve_window(week="2024-W02")
    return _segment_columns(ls.review_dataset(lines, since=since, until=until), "text")


def _triage_with_review(spark, sf_dir):
    return ls.triage(
        spark, render.files(spark, sf_dir, "bracket"), week="2024-W02", include_review=True, reviewer=_reviewer()
    )


def triage_with_review(spark, sf_dir):
    found = _triage_with_review(spark, sf_dir).findings
    return _finding_columns(found, render.file_key().alias("file"), "segment_id")


def triage_with_review_identified(spark, sf_dir):
    return _triage_columns(_triage_with_review(spark, sf_dir).identified)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines_numbered": lines_numbered,
    "lines_gzip": lines_gzip,
    "whole_files": whole_files,
    "lines_cp1252": _charset("iso-8859-1", encoding="cp1252"),
    "lines_latin1": _charset("iso-8859-1", encoding="latin-1"),
    "lines_utf16": _charset("UTF-16LE", encoding="utf-16-le"),
    "lines_utf16_marked": _charset("UTF-16", "UTF-16LE", name="wide_charset", encoding="utf-16"),
    "lines_shift_jis": _charset("Shift_JIS", name="wide_charset", encoding="shift_jis"),
    "lines_gb18030": _charset("GB18030", name="wide_charset", encoding="gb18030"),
    "bad_bytes_euc_kr_replaced": _charset("iso-8859-1", encoding="euc-kr"),
    "bad_bytes_euc_kr_ignored": _charset("iso-8859-1", encoding="euc-kr", decode_errors="ignore"),
    "bad_bytes_replaced": _charset("iso-8859-1"),
    "bad_bytes_ignored": _charset("iso-8859-1", decode_errors="ignore"),
    "suffix_allowlist": suffix_allowlist,
    "own_tokens": own_tokens,
    "default_lookback": default_lookback,
    "sniff_formats": sniff_formats,
    "read_and_sniff": read_and_sniff,
    "hits_access": _hits("access", "access"),
    "hits_syslog": _hits("syslog5424", "syslog"),
    "hits_tokens": _hits("tokens", "unknown"),
    "scan_hits": scan_hits,
    "parse_syslog5424": _parsed("syslog5424", "syslog", meta="syslog"),
    "parse_syslog3164": _parsed("syslog3164", "syslog", meta="syslog"),
    "parse_access": _parsed("access", "access"),
    "parse_bracket": _parsed("bracket5", "bracket"),
    "parse_jsonl": _parsed("jsonl", "jsonl"),
    "parse_cef": _parsed("cef", "cef", meta="cef"),
    "parse_logfmt": _parsed("logfmt", "logfmt", meta="logfmt"),
    "parse_ltsv": _parsed("ltsv", "ltsv", meta="ltsv"),
    "parse_loose": _parsed("loose", "loose"),
    "parse_chain": _parsed("chain", *FORMATS),
    "parse_subset": _parsed("chain", "jsonl", "bracket"),
    "prefilter_fallback": _on_files("fallback", hours_lookback=None),
    "entries_prefilter": _on_files("by_type", hours_lookback=None),
    "entries_full": _on_files("by_type", hours_lookback=None, fast_prefilter=False),
    **{name: _window(selectors) for name, selectors in WINDOWS.items()},
    "default_zone": default_zone,
    "no_timestamp_policy": no_timestamp_policy,
    "levels": levels,
    "contains": contains,
    "exclude_lines": exclude_lines,
    "payload": payload,
    "written_entries": written_entries,
    "written_payload": written_payload,
    "exclude_before_parse": exclude_before_parse,
    "reviewer_failures": reviewer_failures,
    "redact_documents": redact_documents,
    "segments": segments,
    "segments_many_splits": segments_many_splits,
    "segments_dedup": segments_dedup,
    "prompts": prompts,
    "review_fn": review_fn,
    "stored_answers": stored_answers,
    "findings": findings,
    "findings_rejected": findings_rejected,
    "user_parser": user_parser,
    "user_chain": user_chain,
    "own_tables": own_tables,
    "missing_files": missing_files,
    "triage": triage,
    "triage_skipping": triage_skipping,
    "time_zones": time_zones,
    "triage_full": triage_full,
    "review_dataset": review_dataset,
    "triage_with_review": triage_with_review,
    "triage_with_review_identified": triage_with_review_identified,
}
