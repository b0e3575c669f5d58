"""Writers for report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def write_statement(
    lines: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
    partition_by: tuple[str, ...] = ("statement", "period_year"),
) -> None:
    """Write long report rows as folders per statement and year.

    The year comes from the date that ends the period text. Rows are spread by folder before the
    write and a large folder over several tasks, so its files are of balanced size and have no single writer.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    rows = lines
    if "period_year" in partition_by and "period_year" not in lines.columns:
        rows = rows.withColumn("period_year", F.regexp_extract("period", r"(\d{4})-\d\d-\d\d$", 1).try_cast("int"))
    columns = [c for c in partition_by if c in rows.columns]
    writer = rows.hint("rebalance", *columns).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*columns) if columns else writer).save(path)
