"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, whatever is built on it.

    The optimizer copies the expression of a plain column into every filter and
    join condition that uses it.  For a costly one (JSON, long folds) a one-element
    generator keeps it in place, without a shuffle and inside generated code.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
