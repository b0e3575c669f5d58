"""Dense numbering 1..n inside a group without bringing the group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytree.session import pin

# monotonically_increasing_id keeps the partition number above this bit.
_SLICE_BITS = 33


def numbered(
    df: DataFrame, keys: list[str], order: list[Column | str], out: str = "el_order", without: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``out``: the 1-based place of each row among its ``keys`` in ``order``; columns of ``without`` serve the order only.

    The rows are range-partitioned on key and order, so a large group spreads over many
    tasks. The place inside its slice comes from the row id; the rows of earlier slices of
    the same group are added from a table with one row per group and slice.
    """
    columns = [c for c in df.columns if c not in without]
    placed = pin(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .select(*columns, F.monotonically_increasing_id().alias("_place")),
        "numbered",
    ).withColumn("_slice", F.shiftright("_place", _SLICE_BITS))
    spans = placed.groupBy(*keys, "_slice").agg(
        F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        *keys, "_slice", "_start",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    # Null keys are a group as well.
    same = F.col("p._slice") == F.col("o._slice")
    for key in keys:
        same = same & F.col(f"p.{key}").eqNullSafe(F.col(f"o.{key}"))
    return (
        placed.alias("p").join(offsets.alias("o"), same)
        .select("p.*", "o._start", "o._before")
        .withColumn(out, F.col("_place") - F.col("_start") + F.col("_before") + F.lit(1))
        .select(*columns, out)
    )
