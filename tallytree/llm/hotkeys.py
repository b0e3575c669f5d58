"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A value is hot if it holds more than this share of the rows; there are at most 1 / HOT_SHARE such values.
HOT_SHARE = 1 / 256
#: Tasks that the rows of a hot value spread over.
SALTS = 64


def hot_values(counted: DataFrame, column: str, total: int, n: str = "n") -> list:
    """The values of ``column`` with more than HOT_SHARE of ``total`` rows; ``n`` of ``counted`` holds their rows.

    The list is at most 1 / HOT_SHARE long, whatever the size of the data.
    """
    if not total:
        return []
    return [r[0] for r in counted.filter(F.col(n) > HOT_SHARE * total).select(column).distinct().collect()]


def join_spread(left: DataFrame, right: DataFrame, on: list[str], hot_column: str, hot: list, spread: Column) -> DataFrame:
    """Inner join; rows of ``left`` with a hot value go to SALTS places by ``spread``, their partners to all of them.

    ``right`` should have few rows for a value of ``hot_column``, for those of hot values are repeated.
    """
    if not hot:
        return left.join(right, on)
    is_hot = F.col(hot_column).isin(hot)
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(right.withColumn("_salt", F.explode(places)), [*on, "_salt"]).drop("_salt")
