"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import written_table

__all__ = ["ascii_lower", "let", "named", "pieces", "read_table", "running", "values", "written_table"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its literal name, also when that holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A few fixed rows as a local relation."""

    def literal(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value)
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value!r}L" if isinstance(value, int) else f"{value!r}D"

    listed = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also inside other array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, merge: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running results of `merge` over an array, in blocks so that long arrays do not cost their square."""
    whole = lambda part: F.aggregate(part, zero, merge)

    def over(held: Column) -> Column:
        n_blocks = F.ceil(F.size(held) / block).cast("int")
        numbers = F.when(F.size(held) > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda b: F.slice(held, b * block + 1, F.lit(block)))

        def each(blocks: Column, sums: Column) -> Column:
            def inner(own: Column, b: Column) -> Column:
                before = whole(F.slice(sums, F.lit(1), b))
                return let(before, lambda past: F.transform(own, lambda _, i: merge(past, whole(F.slice(own, F.lit(1), i + 1)))))

            return F.flatten(F.transform(blocks, inner))

        return let(blocks, lambda bs: let(F.transform(bs, whole), lambda sums: each(bs, sums)))

    return let(items, over)


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of a pattern (one more than matches), and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
