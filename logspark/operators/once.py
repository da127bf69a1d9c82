"""A fence around expensive computed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def evaluate_once(df: DataFrame, keep: Sequence[str], *columns: str) -> DataFrame:
    """Fix computed columns so that filters above never copy their expressions below.

    A filter on a plain projected column is pushed through the projection, which would run the
    regexes behind that column again for the filter. A generator output is computed once; filters
    on the columns in `keep` (file, line number) still move below it.
    """
    df = df.selectExpr(*keep, f"explode(array(struct({', '.join(columns)}))) AS _x")
    return df.selectExpr(*keep, *[f"_x.{c} AS {c}" for c in columns])
