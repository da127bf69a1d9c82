"""The review dataset: unidentified entries as redacted segments, prompts, and checked findings."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.json_lines import string_only
from logspark.functions.redaction import redact_text
from logspark.functions.text import lits
from logspark.functions.times import iso_text
from logspark.operators.once import evaluate_once
from logspark.session import fits_broadcast, keeps_scan_order, scratch_dir, written_table

# Lines of one file are ranked inside ranges of this many line numbers, so that no task holds a file.
RANGE_LINES = 65536

# A task that sends prompts, and the file it stores, cost as much as some calls do, so it has so many prompts at least, as far as the
# batch goes. A job has so many of these tasks at most, and a file of prompts to be sent about so many.
TASK_PROMPTS = 32
JOB_TASKS = 4096
FILE_PROMPTS = 4096


def split_entries(entries: DataFrame, identified=fixed.REVIEW_IDENTIFIED_LEVELS) -> tuple[DataFrame, DataFrame]:
    """Entries of the identified levels, and all others (the ones to review)."""
    known = F.col("level").isin(list(identified)) if identified else F.lit(False)
    return entries.where(known), entries.where(~known)


def line_text() -> Column:
    """How an entry reads inside a segment."""
    return F.concat(
        F.col("line_no").cast("string"), F.lit(" "),
        F.coalesce(iso_text(F.col("ts"), F.col("ts_naive")), F.lit("-")),
        F.lit(" ["), F.col("level"), F.lit("] "), F.coalesce("message", F.lit("")),
    )


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """Mask personal data and secrets in one text column."""
    return df.withColumn(column, redact_text(F.col(column)))


def stored(entries: DataFrame, name: str) -> DataFrame:
    """Entries as a written table; it keeps `split` only where its parts hold the lines in scan order."""
    return written_table(entries if keeps_scan_order(entries) else entries.drop("split"), name)


def segments(entries: DataFrame, *, max_lines: int = fixed.SEGMENT_LINES, redacted: bool = True) -> DataFrame:
    """Runs of `max_lines` consecutive review entries of a file, in line order.

    `file, segment_id, first_line, last_line, n_lines, text, text_sha256`. Entries with `split` must be a written table (see `stored`),
    or a filter on one: they become segments where they lie, and only segments cut by the end of a split are shuffled. Other
    entries are spread by ranges of line numbers: a range's rank and the numbers of entries before it place an entry, and
    texts are shuffled by range and by segment. Either way entries are counted in a pass over few columns, combined before
    its shuffle, so `entries` should be a table and not a parse still to be done.
    """
    if max_lines < 1:
        raise ValueError("max_lines must be at least 1")
    text = redact_text(line_text()) if redacted else line_text()
    return (_in_place if "split" in entries.columns else _by_ranges)(entries, max_lines, text)


_CUT = "file string, segment_id bigint, size bigint, first_line bigint, last_line bigint, n_lines bigint, text string"


def _in_place(entries: DataFrame, max_lines: int, text: Column) -> DataFrame:
    """A segmented scan over a table whose parts hold lines in order.

    A first scan counts the entries of every split in every piece of the table; running totals of those counts place
    each entry in its file, so a task knows where segments end and how long they are, and puts together those it holds
    whole. All pieces are stored; the few that a border cuts are grouped.
    """
    key = ["part", "block", "file", "split"]
    rows = entries.select(
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), *[c for c in entries.columns if c not in key or c in ("file", "split")],
    )
    counts = rows.groupBy(*key).agg(
        F.min("row").alias("first_row"), (F.max("row") - F.min("row") + 1).alias("span"), F.count("*").alias("n"),
        F.min("line_no").alias("low"), F.max("line_no").alias("high"),
    )
    ordered = Window.partitionBy("file").orderBy("low")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    broken = (F.col("span") != F.col("n")) | (F.max("high").over(earlier) >= F.col("low"))
    index = written_table(counts.select(
        *key, "first_row", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("file")).alias("total"), F.coalesce(broken, F.lit(False)).alias("broken"),
    ), "segment-index")
    if not fits_broadcast(index, 512) or index.where("broken").limit(1).count():
        return _by_ranges(entries, max_lines, text)
    places = index.drop("broken")
    place = F.col("row") - F.col("first_row")
    checked = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place).otherwise(
        F.raise_error(F.lit("pieces of the table changed between two scans")).cast("bigint")
    )
    placed = rows.join(F.broadcast(places), key, "left").select("file", checked.alias("place"), "total", "line_no", text.alias("text"))
    segment = F.floor(F.col("place") / max_lines)
    size = F.least(F.lit(max_lines), F.col("total") - segment * max_lines)
    lined = placed.select("file", segment.alias("segment_id"), size.cast("bigint").alias("size"), "line_no", "text")
    pieces = lined.mapInArrow(_joined_runs, _CUT).withColumn("text_sha256", F.sha2("text", 256))
    built = written_table(pieces, "segments")
    whole = built.where("n_lines = size").drop("size")
    cut = built.where("n_lines < size").groupBy("file", "segment_id").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n_lines").alias("n_lines"),
        F.array_join(F.array_sort(F.collect_list(F.struct("first_line", "text")))["text"], "\n").alias("text"),
    )
    return whole.unionByName(cut.withColumn("text_sha256", F.sha2("text", 256)))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one segment as one row; a run that a batch cuts waits for the next batch."""

    def runs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        table = table.combine_chunks()
        n = table.num_rows
        if not n:
            return None, table
        file, segment, line = (table.column(c).combine_chunks() for c in ("file", "segment_id", "line_no"))
        new = np.ones(n, bool)
        if n > 1:
            other = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = other | (np.diff(np.asarray(segment)) != 0)
            if (~new[1:] & (np.diff(np.asarray(line)) <= 0)).any():
                raise ValueError("entries are not in line order")
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        open_ = 0 if last or ends[-1] - starts[-1] == table.column("size")[-1].as_py() else 1
        starts, ends = starts[: len(starts) - open_], ends[: len(ends) - open_]
        rest = table.slice(ends[-1] if len(ends) else 0)
        if not len(starts):
            return None, rest
        texts = table.column("text").combine_chunks().slice(0, int(ends[-1])).cast(pa.large_string())
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int64()), texts)
        head = table.take(pa.array(starts)).select(["file", "segment_id", "size", "line_no"])
        columns = [c.combine_chunks() for c in head.columns]
        tail = [line.take(pa.array(ends - 1)), pa.array(ends - starts, pa.int64()), pc.binary_join(lists, pa.scalar("\n", pa.large_string())).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *tail], names=["file", "segment_id", "size", "first_line", "last_line", "n_lines", "text"]), rest

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        done, held = runs(table if held is None else pa.concat_tables([held, table]), False)
        if done is not None:
            yield done
    if held is not None and (done := runs(held, True)[0]) is not None:
        yield done


def _by_ranges(entries: DataFrame, max_lines: int, text: Column) -> DataFrame:
    line_range = F.floor((F.col("line_no") - 1) / RANGE_LINES).alias("range")
    rows = entries.select("file", "line_no", line_range, text.alias("text"))

    ranges = rows.groupBy("file", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("file", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    rank = F.row_number().over(Window.partitionBy("file", "range").orderBy("line_no"))
    placed = rows.withColumn("rank", rank).join(offsets, ["file", "range"])
    segment = F.floor((F.col("before") + F.col("rank") - 1) / max_lines)
    grouped = placed.groupBy("file", segment.alias("segment_id")).agg(
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"),
    )
    return grouped.select(
        "file", "segment_id", "first_line", "last_line", "n_lines",
        F.array_join(F.col("parts.text"), "\n").alias("text"),
    ).withColumn("text_sha256", F.sha2("text", 256))


def dedup_segments(found: DataFrame) -> DataFrame:
    """The first segment of every text in a file; only hashes and ids are regrouped, not texts.

    Reads `found` twice, so it should be a table and not segments still to be built.
    """
    first = found.groupBy("file", "text_sha256").agg(F.min("segment_id").alias("segment_id"))
    return found.join(first.select("file", "segment_id"), ["file", "segment_id"], "left_semi")


def prompt_intro(identified=fixed.REVIEW_IDENTIFIED_LEVELS) -> str:
    """What a reviewer is told before the lines."""
    return (
        "You are given lines of an application log that may hide an incident.\n"
        f"Already known elsewhere, so not shown: {', '.join(sorted(set(identified)))}.\n"
        'Reply with one JSON object, shaped {"findings":[{"line_numbers":[int],"severity_guess":"low|medium|high",'
        '"confidence":0..1,"title":str,"rationale":str,"recommendation":str}]}, and nothing else.\n'
        "Name in line_numbers only numbers that stand below. No suspicion means an empty list.\n\nLOG LINES:\n"
    )


def prompts(found: DataFrame, identified=fixed.REVIEW_IDENTIFIED_LEVELS) -> DataFrame:
    """Add the `prompt` a reviewer gets for each segment."""
    return found.withColumn("prompt", F.concat(F.lit(prompt_intro(identified)), F.col("text"), F.lit("\n")))


_ANSWER = "file string, text_sha256 string, response string, error string"


def review_segments(
    found: DataFrame,
    reviewer: Callable[[str], str],
    *,
    concurrency: int | None = None,
    retries: int = 0,
    pause: float = fixed.REVIEW_PAUSE,
    answers: str | None = None,
    batch: int = 1000,
) -> DataFrame:
    """Call `reviewer(prompt) -> response JSON` for every segment: `file, segment_id, response, error`.

    `concurrency` bounds how many calls run at a time (default: the cores of the cluster). A call that raises is
    tried `retries` times more, after `pause` seconds that double up to REVIEW_LONGEST_PAUSE; then its response is NULL and `error`
    names the exception, and the others go on.

    `answers` names a folder in which responses are kept by file and text hash; `found` then needs `text_sha256`. Texts with
    a stored response are not sent again, whichever job stored it, and equal texts of a file are sent once. The others are
    sent by tasks of about `batch / concurrency` segments, and a task's responses are stored when it ends: what a killed job
    has stored is not asked again, and what it was asking is about `batch` segments. With a given `concurrency` every
    `batch` segments are a job; by default the cores take the tasks of a job of many batches one after the other, and a
    task has TASK_PROMPTS segments at least (or `batch`, if that is fewer).
    Failed calls are stored, too, and tried again by the next job.
    """
    bounded = concurrency is not None
    concurrency = concurrency if bounded else found.sparkSession.sparkContext.defaultParallelism
    if concurrency < 1 or retries < 0 or pause < 0 or batch < 1:
        raise ValueError("concurrency and batch must be at least 1, retries and pause at least 0")

    def ask(prompt: str) -> tuple[str | None, str | None]:
        for tried in range(retries + 1):
            try:
                return reviewer(prompt), None
            except Exception as exc:  # noqa: BLE001
                if tried == retries:
                    return None, f"{type(exc).__name__}: {exc}"
                time.sleep(min(fixed.REVIEW_LONGEST_PAUSE, pause * 2**tried))

    def call(batches):
        for part in batches:
            replies = [ask(prompt) for prompt in part["prompt"]]
            part["response"], part["error"] = [a for a, _ in replies], [e for _, e in replies]
            yield part.drop(columns="prompt")

    if answers is None:
        asked = found.select("file", "segment_id", "prompt").repartition(concurrency)
        return asked.mapInPandas(call, "file string, segment_id bigint, response string, error string")

    spark, text = found.sparkSession, ["file", "text_sha256"]
    spark.createDataFrame([], _ANSWER).write.mode("append").parquet(answers)
    known = spark.read.schema(_ANSWER).parquet(answers)
    first = found.groupBy(*text).agg(F.min("segment_id").alias("segment_id")).join(known.where("response IS NOT NULL"), text, "left_anti")
    todo = found.select(*text, "segment_id", "prompt").join(first.select("file", "segment_id"), ["file", "segment_id"], "left_semi")
    n = first.count()
    if n:
        size = max(-(-batch // concurrency), min(batch, TASK_PROMPTS))
        tasks = max(concurrency, -(-n // size))
        jobs = -(-n // batch) if bounded else -(-tasks // JOB_TASKS)
        # Each job's prompts are a folder of their own, so that a later one does not read those before; all are listed once.
        path = f"{scratch_dir(spark)}/asked-{uuid.uuid4().hex}"
        numbered = todo.select(*text, "prompt", F.pmod(F.xxhash64(*text), F.lit(jobs)).alias("job"))
        file = F.pmod(F.hash(*text), F.lit(-(-n // (jobs * FILE_PROMPTS))))
        numbered.repartition("job", file).write.partitionBy("job").parquet(path)
        unasked = spark.read.schema("file string, text_sha256 string, prompt string, job bigint").parquet(path)
        for job in range(jobs):
            some = unasked.where(F.col("job") == job).drop("job")
            replies = some.repartition(concurrency if bounded else -(-tasks // jobs)).mapInPandas(call, _ANSWER)
            # This committer shows a task's file when the task ends, not when the job does.
            replies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(answers)
    stored = spark.read.schema(_ANSWER).parquet(answers)
    best = F.max(F.struct(F.col("response").isNotNull().alias("ok"), "response", "error")).alias("best")
    replies = stored.groupBy(*text).agg(best)
    return found.select("segment_id", *text).join(replies, text).select("file", "segment_id", "best.response", "best.error")


def parse_findings(responses: DataFrame) -> DataFrame:
    """Check response JSON: `file, segment_id, findings, valid`.

    A response is valid when it is an object whose findings (none is fine) all have whole line
    numbers, a known severity, a confidence from 0 to 1 and three texts. `findings` is NULL otherwise.
    """
    def text(f: str, key: str) -> str:
        value = f"try_variant_get({f}, '$.{key}', 'variant')"
        return f"transform(array({value}), v -> {string_only('v')})[0]"

    # Each step is a column of its own, so that no variant is taken apart twice.
    whole = (
        "transform(transform(try_variant_get(f, '$.line_numbers', 'array<variant>'), n -> struct("
        "try_variant_get(n, '$', 'double') AS d, try_variant_get(n, '$', 'bigint') AS b)), "
        "n -> CASE WHEN n.d = floor(n.d) THEN n.b END)"
    )
    fields = (
        f"struct({whole} AS line_numbers, {text('f', 'severity_guess')} AS severity_guess, "
        "try_variant_get(f, '$.confidence', 'double') AS confidence, "
        f"{text('f', 'title')} AS title, {text('f', 'rationale')} AS rationale, {text('f', 'recommendation')} AS recommendation)"
    )
    good = (
        "x.line_numbers IS NOT NULL AND NOT exists(x.line_numbers, n -> n IS NULL) "
        f"AND x.severity_guess IN ({lits(fixed.FINDING_SEVERITIES)}) AND x.confidence BETWEEN 0 AND 1 "
        "AND x.title IS NOT NULL AND x.rationale IS NOT NULL AND x.recommendation IS NOT NULL"
    )
    parsed = responses.selectExpr("file", "segment_id", "try_parse_json(response) AS _v")
    parsed = parsed.selectExpr(
        "file", "segment_id", "startswith(schema_of_variant(_v), 'OBJECT') AS _object",
        "try_variant_get(_v, '$.findings', 'variant') AS _f",
    )
    parsed = parsed.selectExpr(
        "file", "segment_id", "_object AND _f IS NULL AS _none",
        f"CASE WHEN _object THEN transform(try_variant_get(_f, '$', 'array<variant>'), f -> {fields}) END AS _items",
    )
    found = f"CASE WHEN _none THEN array() WHEN forall(_items, x -> {good}) THEN _items END AS findings"
    parsed = evaluate_once(parsed.selectExpr("file", "segment_id", found), ["file", "segment_id"], "findings")
    return parsed.withColumn("valid", F.col("findings").isNotNull())


def keep_findings(parsed: DataFrame, *, min_confidence: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    """Findings sure enough, one per row: `file, segment_id, pos` and the finding's fields."""
    return (
        parsed.where("valid")
        .select("file", "segment_id", F.posexplode("findings").alias("pos", "f"))
        .where(F.col("f.confidence") >= min_confidence)
        .select("file", "segment_id", "pos", "f.*")
    )


def rejected(responses: DataFrame, parsed: DataFrame) -> DataFrame:
    """Responses that failed the check, with their text, and calls that failed, with their error."""
    return responses.join(parsed.where(~F.col("valid")).select("file", "segment_id"), ["file", "segment_id"], "left_semi")


def wanted_levels(identified: Iterable[str], review=fixed.REVIEW_LEVELS) -> list[str]:
    """Levels a review reads at all: the identified and the reviewed ones."""
    return [lv for lv in fixed.LEVELS if lv in set(identified) | set(review)]
