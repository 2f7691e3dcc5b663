"""Keep costly columns from being computed again for a filter above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    The optimizer moves a filter below a projection by repeating the projected
    expression in it; a parsed document or a score grid would then be worked out
    once for the filter and once more for the output.  A generator of exactly
    one row is a step filters do not pass.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
