"""Names for intermediate results that the optimiser does not inline again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions name them.

    inline() of one struct is a row generator: neither projections are merged nor filters pushed through
    it, so that steps stay a line of small projections instead of one expression of exponential size.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda's parameter is a name inside an expression."""
    return F.transform(F.array(value), use)[0]
