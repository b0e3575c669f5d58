"""Replace some rows of tables that are written in buckets, without touching the files of other buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytree.session import drop_path, path_exists

JOURNAL = "_journal"


def replace_rows(
    spark: SparkSession, path: str, fresh: dict[str, DataFrame], gone: DataFrame, keys: list[str],
    bucket: str, bucket_of: Column, batch: str,
) -> list[int]:
    """Take the rows with the keys of ``gone`` out of the tables under ``path`` and put ``fresh`` in; returns the buckets.

    ``fresh`` has the new rows of every table, with the columns that the table has without ``bucket``. Buckets that
    no key falls into keep their files. What affected buckets will hold is first written to a journal, then over
    them; a batch that is repeated after a failure in between goes on from its journal, so rows of other keys are
    never lost. Readers of an affected bucket should wait for the batch. The driver sees bucket numbers only.
    """
    journal = f"{path}/{JOURNAL}/{batch}"
    wanted = [r[0] for r in gone.select(bucket_of.alias("b")).distinct().collect() if r[0] is not None]
    if not wanted:
        return []
    if not path_exists(spark, f"{journal}/done"):
        leave = gone.select(*keys).distinct()
        for name, rows in fresh.items():
            new = rows.withColumn(bucket, bucket_of)
            if path_exists(spark, f"{path}/{name}"):
                # An explicit schema: the folders of a table may all be gone.
                old = spark.read.schema(new.schema).parquet(f"{path}/{name}").filter(F.col(bucket).isin(wanted))
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
                kept = old.alias("o").join(leave.alias("g"), same, "left_anti")
                new = new.unionByName(kept.select(*new.columns))
            _write(new.filter(F.col(bucket).isin(wanted)), f"{journal}/{name}", bucket, "static", keys)
        spark.range(1).write.mode("overwrite").parquet(f"{journal}/done")
    for name, rows in fresh.items():
        held = spark.read.schema(rows.withColumn(bucket, bucket_of).schema).parquet(f"{journal}/{name}")
        _write(held, f"{path}/{name}", bucket, "dynamic", keys)
        filled = {r[0] for r in held.select(bucket).distinct().collect()}
        for empty in set(wanted) - filled:  # a partition without rows is not overwritten
            drop_path(spark, f"{path}/{name}/{bucket}={empty}")
    drop_path(spark, journal)
    return sorted(wanted)


def _write(rows: DataFrame, path: str, bucket: str, overwrite: str, keys: list[str]) -> None:
    """One or more files per bucket, sorted by key inside; a large bucket is split over tasks."""
    (rows.hint("rebalance", bucket).sortWithinPartitions(bucket, *keys)
     .write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy(bucket).parquet(path))
