"""User parsers: a Python function per line, alone or inside a chain."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark import fixed
from logspark.operators.parse import ENTRY_COLUMNS, ENTRY_SCHEMA, parse_entries

_ENTRY = f"struct<{ENTRY_SCHEMA}>"
_KIND = "ts timestamp, ts_naive boolean, level string, message string, meta " + ENTRY_SCHEMA.partition(" meta ")[2]
_TEXTS = pa.map_(pa.string(), pa.string())
_META = pa.struct({
    "syslog": pa.struct({"pri": pa.int32(), "severity": pa.int32(), "facility": pa.int32(), "host": pa.string(), "app": pa.string()}),
    "cef": pa.struct({
        "version": pa.string(), "device_vendor": pa.string(), "device_product": pa.string(), "device_version": pa.string(),
        "signature_id": pa.string(), "name": pa.string(), "severity": pa.string(), "extension": _TEXTS,
    }),
    "logfmt": _TEXTS, "ltsv": _TEXTS,
})
_FOUND = pa.struct({
    "ts": pa.timestamp("us", "UTC"), "ts_naive": pa.bool_(), "level": pa.string(), "message": pa.string(), "meta": _META,
})


def _pairs(kind: pa.DataType, value):
    """A value in the shape Arrow takes: maps as lists of pairs."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return [(k, None if v is None else str(v)) for k, v in dict(value).items()]
    if pa.types.is_struct(kind):
        return {f.name: _pairs(f.type, value.get(f.name)) for f in kind}
    return value


def parsed_by(parser: Callable[[int, str], dict | None], line: Column | str = "line") -> Column:
    """What `parser(line_no, line)` says, as one struct column: `ts, ts_naive, level, message, meta`, NULL where it passes.

    A vectorised function: only the line's number and text go to Python, all other columns stay where they are. A
    NULL line is not shown to the parser.
    """

    def one(line_no: int | None, line: str | None) -> dict | None:
        got = None if line is None else parser(line_no, line)
        if got is None:
            return None
        ts = got.get("ts")
        naive = None if ts is None else ts.tzinfo is None
        if ts is not None:
            ts = ts.replace(tzinfo=timezone.utc) if naive else ts.astimezone(timezone.utc)
        return {
            "ts": ts, "ts_naive": naive, "level": str(got.get("level") or "UNKNOWN"), "message": str(got.get("message", line)),
            "meta": _pairs(_META, got.get("meta")),
        }

    def run(line_no: pa.Array, line: pa.Array) -> pa.Array:
        return pa.array([one(n, x) for n, x in zip(line_no.to_pylist(), line.to_pylist(), strict=True)], _FOUND)

    return F.arrow_udf(run, _KIND).asNondeterministic()("line_no", line)  # evaluated once, wherever it is read


def _entry(found: Column, fmt: str, line: Column) -> Column:
    """An entry struct of what a parser found; NULL where it found nothing."""
    fields = {
        "file": F.col("file"), "line_no": F.col("line_no").cast("bigint"), "fmt": F.lit(fmt), "raw": line,
        **{f.name: found[f.name] for f in _FOUND},
    }
    return F.when(found.isNotNull(), F.struct(*[fields[c].alias(c) for c in ENTRY_COLUMNS]).cast(_ENTRY))


def parse_with(
    lines: DataFrame, parser: Callable[[int, str], dict | None], *, fmt: str | None = None, hit_level: str | None = None,
    carry: Iterable[str] = (),
) -> DataFrame:
    """Run `parser(line_no, line) -> dict or None` over the lines: entries.

    The dict may hold `ts` (datetime), `level`, `message` and `meta`; None drops the line, or, with
    `hit_level`, keeps it with that level and the stripped line. `carry` names further columns to pass through.
    """
    named = parser if fmt is None else _Named(parser, fmt)
    return parse_mixed(lines, [named], hit_level=hit_level, carry=carry)


class _Named:
    """A parser under another name."""

    def __init__(self, parser: Callable, name: str):
        self.parser, self.__name__ = parser, name

    def __call__(self, line_no: int, line: str) -> dict | None:
        return self.parser(line_no, line)


def parse_mixed(
    lines: DataFrame, formats: Sequence[str | Callable], *, hit_level: str | None = None, carry: Iterable[str] = (), **options
) -> DataFrame:
    """A chain in which some formats are functions: each part parses what the parts before it left."""
    runs: list = []
    for item in formats:
        if callable(item) or not runs or callable(runs[-1]):
            runs.append(item if callable(item) else [item])
        else:
            runs[-1].append(item)

    # All lines go through every part once; a line that is taken keeps its entry.
    keep = list(dict.fromkeys([*([hit_level] if hit_level else []), *carry]))
    rest = lines.select("file", "line_no", "line", *keep, F.lit(None).cast(_ENTRY).alias("_e"))
    for part in runs:
        if callable(part):
            shown = F.when(F.col("_e").isNull(), F.col("line"))
            tried = rest.withColumn("_found", parsed_by(part, shown))
            new = _entry(F.col("_found"), getattr(part, "__name__", "user"), F.col("line"))
            rest = tried.withColumn("_e", F.coalesce("_e", new)).drop("_found")
        else:
            marked = rest.withColumn("_mark", F.lit("?"))
            parsed = parse_entries(marked, part, hit_level="_mark", carry=[*keep, "_e"], **options)
            taken = F.col("fmt").isNotNull() & F.col("_e").isNull()
            rest = parsed.select(
                "file", "line_no", F.col("raw").alias("line"), *keep,
                F.when(taken, F.struct(*ENTRY_COLUMNS)).otherwise(F.col("_e")).alias("_e"),
            )
    e = F.col("_e")
    if hit_level is None:
        return rest.where(e.isNotNull()).select("_e.*", *carry)
    kept = rest.where(e.isNotNull() | F.col(hit_level).isNotNull())
    return kept.select(
        "file", F.col("line_no").cast("bigint").alias("line_no"), "_e.fmt", "_e.ts", "_e.ts_naive",
        F.coalesce(F.col("_e.level"), F.col(hit_level)).alias("level"),
        F.coalesce(F.col("_e.message"), F.btrim("line", F.lit(fixed.BLANKS))).alias("message"),
        F.col("line").alias("raw"), "_e.meta", *carry,
    )
