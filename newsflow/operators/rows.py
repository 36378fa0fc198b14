"""Arrays to rows."""

from pyspark.sql import Column, DataFrame, functions as F


def explode_present(df: DataFrame, array: Column, name: str) -> DataFrame:
    """Adds ``name``, one row per non-null element.

    A plain explode makes the optimizer test the array's size ahead of it, which for a
    computed array means computing it twice; an outer explode does not.
    """
    return df.select("*", F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
