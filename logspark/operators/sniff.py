"""Format detection per file, and the candidate prefilter that depends on it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark import fixed
from logspark.functions.levels import pri_level, status_level
from logspark.functions.text import ascii_upper, first_match, lit
from logspark.operators.once import evaluate_once
from logspark.session import fits_broadcast, join_by_file, prepare, written_table
from logspark.sources.lines import block_index, file_path, line_text, numbered, raw_lines, rows_before, text_files, time_ranges, with_splits, zipped

_ASCII_BLANKS = " \t\n\r\x0b\x0c"


# Closed files that are left out by name.
MOST_NAMED = 50_000
# The order in which a file's format is settled.
_KINDS = ("access", "syslog", "jsonl", "bracket")
# Bits of a row id that number the rows of one task.
_IN_TASK = (1 << 33) - 1
# Of files up to these bytes every line is looked at while lines are counted, as many share a task and where one begins is not known there.
SMALL_FILE = 1 << 20


def _looks(line: Column, max_bytes: int) -> dict[str, Column]:
    """Whether the head of a line looks like each of the formats."""
    cut = F.substring(line.cast("binary"), 1, max_bytes).cast("string")
    s = F.btrim(F.when(F.octet_length(line) > max_bytes, cut).otherwise(line), F.lit(_ASCII_BLANKS))
    return dict(zip(_KINDS, (
        s.rlike(fixed.SNIFF_ACCESS), s.rlike(fixed.SNIFF_SYSLOG), s.startswith("{") & s.endswith("}"), s.rlike(fixed.SNIFF_BRACKET),
    ), strict=True))


def _guess(sample_lines: int) -> Column:
    """A file's format by its counts; a gzip file is judged by its compressed bytes, which look like nothing."""
    enough = max(3, sample_lines // 10)
    guess = F.when(F.lower("file").endswith(".gz"), "unknown")
    for name in _KINDS:
        guess = guess.when(F.col(name) >= enough, name)
    return guess.otherwise("unknown").alias("detected")


def _head_counts(lines: DataFrame, sample_lines: int, max_bytes: int) -> DataFrame:
    head = lines.where(F.col("line_no") <= sample_lines)
    return head.groupBy("file").agg(*[F.count_if(c).alias(name) for name, c in _looks(F.col("line"), max_bytes).items()])


def sniff_formats(
    lines: DataFrame, sample_lines: int = fixed.SNIFF_LINES, max_bytes_per_line: int = fixed.SNIFF_BYTES
) -> DataFrame:
    """Guess each file's format from its first lines: `file, detected`.

    Takes a scan of `lines`; `read_and_sniff` finds the same while it counts lines.
    """
    return _head_counts(lines, sample_lines, max_bytes_per_line).select("file", _guess(sample_lines))


def _index_with_heads(raw: DataFrame, looked: Column, sample_lines: int, ranges: list[Column]) -> DataFrame:
    """`block_index` with each split's size, its time ranges and, a kind, how many of its first `sample_lines` lines look like it.

    `raw` holds the `looks` of the lines that are `looked` at, which are all among the first ones or all of the split.
    Rows of a split follow each other, so the least row of each remainder by some number N gives its first N rows, wherever the split
    begins in its task: a bounded, mergeable aggregate of long integers, each a row with its looks.
    """
    bits = len(_KINDS)
    slots = 1 << max(0, sample_lines - 1).bit_length()
    slot = F.when(looked, F.col("row").bitwiseAND(F.lit(slots - 1))).otherwise(F.lit(0)).alias("slot")
    head = F.shiftleft("row", bits).bitwiseOR(F.col("looks").cast("bigint")).alias("head")
    times = [c for c in ("least", "greatest", "open") if c in raw.columns]
    parts = raw.select("file", "block", "row", "size", slot, head, *times).groupBy("file", "block", "slot").agg(
        F.min("row").alias("first_row"), F.count("*").alias("n_rows"), F.max("size").alias("size"), F.min("head").alias("head"), *ranges
    )
    whole = {"least": F.min, "greatest": F.max, "open": F.sum}
    blocks = parts.groupBy("file", "block").agg(
        F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), F.max("size").alias("size"),
        F.collect_list("head").alias("heads"), *[whole[c](c).alias(c) for c in times],
    )

    def like(i: int) -> Column:
        among = lambda h: (F.shiftright(h, bits) - F.col("first_row") < sample_lines) & (h.bitwiseAND(F.lit(1 << i)) != 0)
        return F.size(F.filter("heads", among)).cast("bigint")

    return rows_before(blocks.select("*", *[like(i).alias(name) for i, name in enumerate(_KINDS)]).drop("heads"))


def read_and_sniff(
    spark: SparkSession,
    paths: str | Sequence[str],
    sample_lines: int = fixed.SNIFF_LINES,
    max_bytes_per_line: int = fixed.SNIFF_BYTES,
    *,
    encoding: str = "utf-8",
    decode_errors: str = "replace",
    line_sep: str | None = None,
    allowed_only: bool = False,
    keep_split: bool = False,
    only: Column | None = None,
    times: Callable[[DataFrame, Column], DataFrame] | None = None,
    closed: Column | None = None,
    sniff: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """`read_lines` of files, and their formats (`file, detected`, a written table; no row for a file without lines).

    The scan that counts the lines of every split looks at the first lines on the way: where a file's first split
    is also its task's first, a row's number in the task is its place. That holds for every file of at least a split's
    size. Of files up to SMALL_FILE, many of which share a task, all lines are looked at and the first ones kept. Files between
    the two that do not begin their task, and files whose first split has too few lines, are read once more (with an index of their
    own, unless these are all files).

    `only` leaves files out by path and size. `times` (see `zones`) adds to raw lines their times, of which the counting scan keeps
    the range a split, and `closed` tells of such a range that no line is wanted: then lines of closed splits are dropped
    before they are parsed, and where closed files are half of the bytes or more, they are not read again (the others
    are counted again). Without `sniff` no formats are settled.
    """
    prepare(spark)
    scan = text_files(spark, paths, encoding, line_sep, allowed_only)
    raw = raw_lines(scan, only)
    text = line_text(raw, encoding, decode_errors)
    small = (F.col("size") <= SMALL_FILE) & ~zipped(F.col("file"))
    first = (F.col("block") == 0) & ((F.col("row").bitwiseAND(F.lit(_IN_TASK)) < sample_lines) | small)
    looked = raw
    if sniff:
        # One number for a line's looks, so that nothing of it is computed for lines that are not looked at.
        looks = _looks(line_text(raw, encoding, decode_errors, first), max_bytes_per_line).values()
        looked = raw.withColumn("looks", F.when(first, sum((c.cast("int") * (1 << i) for i, c in enumerate(looks)), F.lit(0))))
    looked = looked if times is None else times(looked, text)
    ranges = [] if times is None else time_ranges()
    if sniff:
        index = _index_with_heads(looked, first, sample_lines, ranges)
    else:
        index = block_index(looked, F.max("size").alias("size"), *ranges)
    index = written_table(with_splits(index) if keep_split else index, "line-index")
    every = numbered(raw, index, text)
    lines = every
    if times is not None:
        lines, kept = _open_lines(scan, raw, index, text, closed, only)
        if kept is not None:
            every, only = lines, kept
    if not sniff:
        return lines, None

    head = (F.col("block") == 0) & ((F.col("first_row").bitwiseAND(F.lit(_IN_TASK)) == 0) | small)
    files = index.groupBy("file").agg(
        F.max("size").alias("size"), F.coalesce(F.max(F.when(head, F.col("n_rows"))), F.lit(0)).alias("seen"),
        F.sum("n_rows").alias("n_lines"), *[F.max(name).alias(name) for name in _KINDS],
    )
    settled = F.lower("file").endswith(".gz") | (F.col("seen") >= F.least(F.lit(sample_lines), F.col("n_lines")))
    files = files.withColumn("settled", settled)
    found = files.where("settled").select("file", *_KINDS)
    open_size = F.when(~F.col("settled"), F.col("size"))
    least, largest, lowest, highest = files.agg(F.min("size"), F.max("size"), F.min(open_size), F.max(open_size)).first()
    if highest is not None:
        again = every
        if least < lowest or highest < largest:
            few = F.col("_metadata.file_size").between(lowest, highest)
            small = raw_lines(scan, few if only is None else few & only)
            again = numbered(small, written_table(block_index(small), "line-index"), text)
        others = _head_counts(again, sample_lines, max_bytes_per_line)
        found = found.unionByName(others.join(files.where("NOT settled").select("file"), "file", "left_semi"))
    return lines, written_table(found.select("file", _guess(sample_lines)), "detected")


def _open_lines(
    scan: list[DataFrame], raw: DataFrame, index: DataFrame, text: Column, closed: Column, only: Column | None
) -> tuple[DataFrame, Column | None]:
    """Numbered lines of the splits that are not closed, and the condition on files where whole ones are left out."""
    by_file = index.groupBy("file").agg(
        F.max("size").alias("size"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("open").alias("open")
    ).withColumn("closed", closed)
    size, shut, n = by_file.agg(F.sum("size"), F.sum(F.when(F.col("closed"), F.col("size"))), F.count_if("closed")).first()
    if n and 2 * shut >= size and n <= MOST_NAMED:
        names = [r["file"] for r in by_file.where("closed").select("file").collect()]
        kept = ~file_path().isin(names) if only is None else only & ~file_path().isin(names)
        few = raw_lines(scan, kept)
        again = block_index(few)
        return numbered(few, written_table(with_splits(again) if "split" in index.columns else again, "line-index"), text), kept
    shut_blocks = index.where(closed).select(F.col("file").alias("of_file"), F.col("block").alias("of_block"))
    if not shut_blocks.limit(1).count() or not fits_broadcast(shut_blocks.withColumnRenamed("of_file", "file")):
        return numbered(raw, index, text), None
    same = (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block"))
    return numbered(raw.join(F.broadcast(shut_blocks), same, "left_anti"), index, text), None


def hit_level(
    tokens: Mapping[str, Iterable[str]] = fixed.SCAN_TOKENS, case_insensitive: bool = True
) -> str:
    """Level the prefilter gives a line, NULL when the line is no candidate.

    Reads the columns `detected`, `line` and `_up` (the upper-cased line).
    """
    access = lit(fixed.SNIFF_ACCESS.removesuffix(r"\s+") + r"(?:\s|$)")
    status = f"try_cast(regexp_extract(line, {access}, 1) AS int)"
    pri = f"try_cast(regexp_extract(line, {lit(fixed.SNIFF_SYSLOG)}, 1) AS int)"
    ladder = {
        level: [t.upper() if case_insensitive else t for t in tokens.get(level, ())] for level in fixed.LEVELS
    }
    return (
        f"CASE WHEN detected = 'access' THEN nullif({status_level(status)}, 'INFO') "
        f"WHEN detected = 'syslog' THEN CASE WHEN {pri} % 8 <= 4 THEN {pri_level(pri)} END "
        f"ELSE {first_match(ladder, '_up' if case_insensitive else 'line')} END"
    )


def with_detected(lines: DataFrame, detected: DataFrame | str) -> DataFrame:
    """Add the `detected` column: a format name for all files, or a `file, detected` table (`unknown` for files it does not name)."""
    if isinstance(detected, str):
        if detected not in fixed.DETECTED:
            raise ValueError(f"unknown format {detected!r}; known: {', '.join(fixed.DETECTED)}")
        return lines.withColumn("detected", F.lit(detected))
    joined = join_by_file(lines, written_table(detected, "detected"))
    return joined.withColumn("detected", F.coalesce("detected", F.lit("unknown")))


def scan_hits(
    lines: DataFrame,
    detected: DataFrame | str | None = None,
    *,
    tokens: Mapping[str, Iterable[str]] = fixed.SCAN_TOKENS,
    case_insensitive: bool = True,
    sample_lines: int = fixed.SNIFF_LINES,
    pass_unknown: bool = False,
) -> DataFrame:
    """Candidate lines: `file, line_no, hit_level, line`, and further columns of `lines`.

    Access files keep 4xx/5xx, syslog files PRI warnings and worse, all others lines with a level
    token. With `pass_unknown`, every line of an unrecognised file passes, without a level.
    """
    if detected is None:
        detected = sniff_formats(lines, sample_lines)
    line, name = F.col("line"), F.col("detected")
    upper = F.when(~name.isin("access", "syslog"), ascii_upper(line)).alias("_up")
    more = [c for c in lines.columns if c not in ("file", "line_no", "line", "detected", "hit_level")]
    out = with_detected(lines, detected).select("file", "line_no", "line", "detected", upper, *more)
    level = hit_level(tokens, case_insensitive)
    if pass_unknown:
        level = f"CASE WHEN detected <> 'unknown' THEN {level} END"
    out = out.selectExpr("file", "line_no", "line", "detected", *more, f"{level} AS hit_level")
    out = evaluate_once(out, ["file", "line_no", "line", "detected", *more], "hit_level")
    keep = F.col("hit_level").isNotNull()
    out = out.where(keep | (name == "unknown") if pass_unknown else keep)
    return out.select("file", "line_no", "hit_level", "line", *more)
