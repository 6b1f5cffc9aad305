"""Columns that are computed once, however often they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, made by a generator of one row.

    Projections above it are not merged with it and filters are not pushed through it, so no plan
    holds the expressions twice. It stays in the JVM and moves no row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
