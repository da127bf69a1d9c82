"""Text files as a table of numbered lines, and whole files as text values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.fixed import ALLOWED_SUFFIXES
from logspark.session import lookup_side, prepare, written_table

_BROKEN = "�"


def allowed_glob() -> str:
    """Glob for the allowed suffixes and their gzip forms, any letter case."""
    any_case = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    names = [any_case(s) + z for s in ALLOWED_SUFFIXES for z in ("", "." + any_case("gz"))]
    return "*.{" + ",".join(names) + "}"


def decoded(value: Column, encoding: str = "utf-8", errors: str = "replace") -> Column:
    """Bytes of a line as text; bad bytes are replaced, left out, or an error."""
    if errors not in ("replace", "ignore", "strict"):
        raise ValueError("decode_errors must be 'replace', 'ignore' or 'strict'")
    name = encoding.lower().replace("_", "-")
    if name in ("utf-8", "utf8", "utf-8-sig"):
        if errors == "strict":
            return F.validate_utf8(value)
        if errors == "replace":
            return F.make_valid_utf8(value)
        # A line holds no newline, so it can stand in for replacement characters that are real.
        held = F.make_valid_utf8(F.replace(value, F.lit(_BROKEN), F.lit("\n")))
        return F.replace(F.replace(held, F.lit(_BROKEN), F.lit("")), F.lit("\n"), F.lit(_BROKEN))
    if name in ("ascii", "us-ascii"):
        if errors == "strict":
            return F.decode(value.cast("binary"), "US-ASCII")
        wide = F.decode(value.cast("binary"), "ISO-8859-1")
        return F.regexp_replace(wide, r"[\x80-\xff]", _BROKEN if errors == "replace" else "")
    if name in ("latin-1", "latin1", "iso-8859-1"):
        return F.decode(value.cast("binary"), "ISO-8859-1")
    if name in _UTF16:
        # Without a byte that a surrogate could hold, and of even length, nothing can be bad.
        easy = ~_latin(value).rlike(r"[\xd8-\xdf]") & (F.octet_length(value) % 2 == 0)
        return _by_codec(value, name, errors, easy, F.decode(F.when(easy, value.cast("binary")), _UTF16[name]))
    if name in _MARKED:
        return _by_codec(value, name, errors, F.lit(False), F.lit(None).cast("string"))
    table = _bytes_alone(encoding)
    if table is not None:
        return _one_byte(value, encoding, errors, table)
    easy = ~_latin(value).rlike(r"[\x80-\xff]")
    return _by_codec(value, encoding, errors, easy, value)


_UTF16 = {"utf-16-le": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-16be": "UTF-16BE"}
_MARKED = ("utf-16", "utf16")  # the byte order stands at the start of each file; little-endian without a mark
_MARK = "\ufeff"


def _latin(value: Column) -> Column:
    """Every byte as the character of its number."""
    return F.decode(value.cast("binary"), "ISO-8859-1")


def _by_codec(value: Column, encoding: str, errors: str, easy: Column, plain: Column) -> Column:
    """`plain` for easy lines; only the others' bytes go to Python's decoder, in Arrow batches.

    Newlines after a line tell the decoder that a character cut short is a bad one, as it stands in the file; characters have
    four bytes at most.
    """
    newline = "\n".encode(encoding) if encoding not in _MARKED else b""

    @F.pandas_udf("string")
    def hard(values: pd.Series) -> pd.Series:
        return values.map(lambda b: b if b is None else _decode(bytes(b)))

    def _decode(line: bytes) -> str:
        if newline and len(line) % len(newline) == 0:
            return (line + 3 * newline).decode(encoding, errors)[:-3]
        return line.decode(encoding, errors)

    return F.when(easy, plain).otherwise(hard(F.when(~easy, value.cast("binary"))))


def _bytes_alone(encoding: str) -> list[str] | None:
    """The character of each byte, or None where characters of several bytes stand over ASCII.

    Line ends must be bytes of their own: charsets that swallow them, keep a state between lines or change ASCII are refused.
    """
    refused = ValueError(f"unsupported encoding {encoding!r}; use utf-8, utf-16, or a charset over ASCII without states")
    try:
        ascii_text = bytes(range(128)).decode(encoding, "replace")
        table = [bytes([b]).decode(encoding, "replace") for b in range(256)]
        swallowed = any(bytes([b, e]).decode(encoding, "replace")[-1:] != chr(e) for b in range(256) for e in (10, 13))
    except LookupError:
        raise ValueError(f"unknown encoding {encoding!r}") from None
    except UnicodeError:
        raise refused from None
    if swallowed or ascii_text != "".join(map(chr, range(128))) or table[:128] != list(ascii_text):
        raise refused
    leads = any(
        len(bytes([b, x]).decode(encoding, "replace")) != 2 for b, c in enumerate(table) if c == _BROKEN for x in (0x41, 0x80, 0xA1)
    )
    return None if leads or any(len(c) != 1 for c in table) else table


def _one_byte(value: Column, encoding: str, errors: str, table: list[str]) -> Column:
    """Bytes in a charset of one byte a character: read as latin-1, then the characters that differ exchanged."""
    wide = _latin(value)
    other = [(chr(b), c) for b, c in enumerate(table) if c != chr(b)]
    bad = "".join(f"\\x{ord(b):02x}" for b, c in other if c == _BROKEN)
    if bad and errors == "strict":
        broken = F.raise_error(F.lit(f"bytes that {encoding} does not know")).cast("string")
        wide = F.when(wide.rlike(f"[{bad}]"), broken).otherwise(wide)
    if bad and errors == "ignore":
        wide = F.regexp_replace(wide, f"[{bad}]", "")
    return F.translate(wide, "".join(b for b, _ in other), "".join(c for _, c in other)) if other else wide


# Lines of a file that cannot be split go to other tasks in ranges of this many, where such files are fewer than cores.
SPREAD_LINES = 4096


def text_files(
    spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8", line_sep: str | None = None, allowed_only: bool = False
) -> list[DataFrame]:
    """The files' lines as Spark reads them, listed once for all scans of `raw_lines`.

    One scan, or one a byte order: with `utf-16` a scan of its own, which decodes nothing, finds the mark at the start of every
    file, by which all splits of the file are read. The names of the rarer order then stand in the plan.
    """
    name = encoding.lower().replace("_", "-")
    if name in _MARKED:
        little, big = (text_files(spark, paths, f"utf-16-{order}", line_sep, allowed_only)[0] for order in ("le", "be"))
        start = F.hex(F.substring(F.col("value").cast("binary"), 1, 2))
        marks = raw_lines([little]).where("block = 0").groupBy("file").agg((F.min_by(start, "row") == "FEFF").alias("big"))
        marks = written_table(marks, "byte-orders")
        n_big, n = marks.agg(F.count_if("big"), F.count("*")).first()
        if not n_big:
            return [little]
        rare = 2 * n_big <= n
        names = [r["file"] for r in marks.where(F.col("big") == rare).select("file").collect()]
        among = file_path().isin(names) if names else F.lit(False)
        return [little.where(~among if rare else among), big.where(among if rare else ~among)]
    reader = spark.read
    wide = _UTF16.get(name)
    if wide:  # lines end at the separator's own two bytes; inner carriage returns stay
        reader, line_sep = reader.option("encoding", wide), line_sep or "\n"
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    if allowed_only:
        reader = reader.option("pathGlobFilter", allowed_glob())
    return [reader.text([paths] if isinstance(paths, str) else list(paths))]


def file_path() -> Column:
    """A scan's file, by which whole files are left out before they are opened."""
    return F.col("_metadata.file_path")


def raw_lines(files: list[DataFrame], only: Column | None = None) -> DataFrame:
    """Lines as stored, with their split: `file, size, block, row, value`, and `big` where files differ in byte order.

    `only` is a condition on the scan's file (its path and size): other files are not read. It stands below the numbers of the
    rows, which a later filter could not pass.
    """
    orders = [[], []] if len(files) == 1 else [[F.lit(False).alias("big")], [F.lit(True).alias("big")]]
    scans = [
        (scan if only is None else scan.where(only)).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value"),
            *order,
        )
        for scan, order in zip(files, orders, strict=False)
    ]
    return reduce(DataFrame.unionByName, scans)


def line_text(raw: DataFrame, encoding: str = "utf-8", decode_errors: str = "replace", where: Column | None = None) -> Column:
    """The text of a stored line, without its end; given `where`, of those lines only, and no other is decoded."""
    value = F.col("value") if where is None else F.when(where, F.col("value"))
    if encoding.lower().replace("_", "-") not in _MARKED:
        return F.rtrim(decoded(value, encoding, decode_errors), F.lit("\r\n"))
    text = decoded(value, "utf-16-le", decode_errors)
    if "big" in raw.columns:
        big = F.col("big")
        text = F.when(big, decoded(F.when(big, value), "utf-16-be", decode_errors)).otherwise(
            decoded(F.when(~big, value), "utf-16-le", decode_errors)
        )
    text = F.when((F.col("block") == 0) & text.startswith(_MARK), F.substr(text, F.lit(2))).otherwise(text)
    return F.rtrim(text, F.lit("\r\n"))


def block_index(raw: DataFrame, *more: Column) -> DataFrame:
    """Per split of a file: its first row id, its rows, the rows of the file before it, and `more` aggregates."""
    return rows_before(raw.groupBy("file", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows"), *more))


def rows_before(blocks: DataFrame) -> DataFrame:
    """Add to counted splits (`file, block, n_rows`) the rows of the file before them."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))


def time_ranges() -> list[Column]:
    """What a split keeps of its lines' times (see `operators/zones.py`)."""
    return [F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.count_if("open").alias("open")]


def with_splits(index: DataFrame) -> DataFrame:
    """Add `split`: a number a split that grows with the file's name and the place in the file. Moves the index only."""
    return index.orderBy("file", "block").withColumn("split", F.monotonically_increasing_id())


def numbered(raw: DataFrame, index: DataFrame, text: Column) -> DataFrame:
    """`file, line_no, line` of raw lines by the written index of the same scan, and `split` where the index has it."""
    more = [c for c in ("split",) if c in index.columns]
    places = index.select("file", "block", "first_row", "n_rows", "before", *more)
    place = F.col("row") - F.col("first_row")
    number = F.when(
        F.col("first_row").isNotNull() & (place >= 0) & (place < F.col("n_rows")), F.col("before") + place + 1
    ).otherwise(F.raise_error(F.lit("file splits changed between two scans")).cast("bigint"))
    return raw.join(lookup_side(places), ["file", "block"], "left").select("file", number.alias("line_no"), text.alias("line"), *more)


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    decode_errors: str = "replace",
    line_sep: str | None = None,
    allowed_only: bool = False,
    keep_split: bool = False,
) -> DataFrame:
    """Read text or gzip files as `file, line_no, line`, numbered from 1 within each file.

    Numbering shuffles no line: a first pass that decodes nothing counts the rows of every split, the
    per-file running total of those counts is a small table, and a second scan adds it to the row's
    place in its split. Both scans must cut the files alike; every row checks that its place lies
    inside the counted split and the query fails otherwise. `line_sep="\\n"` keeps inner carriage
    returns, the default splits on `\\n`, `\\r\\n` and `\\r`. `keep_split` adds `split`, which numbers the splits of all files
    in order: what it goes through without a shuffle can be written, or cut into segments, in line order without one.

    A gzip file is decoded by one task. Where such files are fewer than cores, their numbered lines are spread over tasks by file
    and range of lines, so that what follows is not bound to that task; lines of other files stay, and all stay with `keep_split`.
    """
    prepare(spark)
    files = text_files(spark, paths, encoding, line_sep, allowed_only)
    raw = raw_lines(files)
    text = line_text(raw, encoding, decode_errors)
    if keep_split:
        return numbered(raw, written_table(with_splits(block_index(raw)), "line-index"), text)
    return spread_whole_files(files, lambda raw: numbered(raw, written_table(block_index(raw), "line-index"), text))


def zipped(file: Column) -> Column:
    """Whether a file is read by one task from its first line to its last."""
    return F.lower(file).endswith(".gz")


def spread_whole_files(files: list[DataFrame], read: Callable[[DataFrame], DataFrame], only: Column | None = None) -> DataFrame:
    """`read` the raw lines of all files; lines of gzip files are spread where the files are fewer than cores."""
    sc, whole = files[0].sparkSession.sparkContext, zipped(file_path())
    n_parts = lambda cond: sum(f.where(cond).select("value").rdd.getNumPartitions() for f in files)
    some = whole if only is None else whole & only
    if not 0 < n_parts(some) < sc.defaultParallelism:
        return read(raw_lines(files, only))
    line_range = F.floor((F.col("line_no") - 1) / SPREAD_LINES)
    spread = read(raw_lines(files, some)).repartition("file", line_range)
    rest = ~whole if only is None else ~whole & only
    if not n_parts(rest):
        return spread
    return read(raw_lines(files, rest)).unionByName(spread)


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    decode_errors: str = "replace",
    allowed_only: bool = True,
) -> DataFrame:
    """Read each file as one text value: `file, text`, with `\\r\\n` and `\\r` read as `\\n`."""
    prepare(spark)
    reader = spark.read
    if allowed_only:
        reader = reader.option("pathGlobFilter", allowed_glob())
    # Make the newline stand-in of `decoded` harmless: whole texts do hold newlines.
    if decode_errors == "ignore" and encoding.lower() in ("utf-8", "utf8"):
        text = F.array_join(
            F.transform(F.split("value", "\n"), lambda v: decoded(v, encoding, decode_errors)), "\n"
        )
    else:
        text = decoded(F.col("value"), encoding, decode_errors)
    return reader.text([paths] if isinstance(paths, str) else list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace(text, r"\r\n?", "\n").alias("text")
    )
