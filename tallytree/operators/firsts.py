"""First-wins picks.

``row_number() = 1`` and ``rank() = 1`` filters become a group limit that Spark applies
before the shuffle, so a key that holds a third of the rows sends one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK = "_first_rank"


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in the given order; ``order`` should be total."""
    return top_n_per(df, keys, order, 1)


def top_n_per(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of every key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= n).drop(_RANK)


def leading_ties(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """All rows that tie for the first place of their key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.rank().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)
