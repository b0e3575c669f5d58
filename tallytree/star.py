"""The filing star: seven tables that share ``filing_id``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytree.session import path_exists
from tallytree.sources.buckets import replace_rows

# Document order does not survive in Spark, so it is a column: role_seq, arc_seq, label_seq, fact_seq.
SCHEMAS = {
    "role": "filing_id BIGINT, role_seq BIGINT, role_id STRING, type STRING, description STRING",
    "presentation": "filing_id BIGINT, arc_seq BIGINT, role_id STRING, from_element_id STRING, "
    "to_element_id STRING, arc_order STRING, preferred_label STRING",
    "calculation": "filing_id BIGINT, role_id STRING, from_element_id STRING, to_element_id STRING, "
    "arc_order STRING, arcrole STRING",
    "element": "filing_id BIGINT, element_id STRING, balance STRING",
    "label": "filing_id BIGINT, label_seq BIGINT, element_id STRING, label_role STRING, lang STRING, "
    "label_string STRING",
    "fact": "filing_id BIGINT, fact_seq BIGINT, element_id STRING, context_id STRING, fact STRING, "
    "decimals STRING",
    "context": "filing_id BIGINT, context_id STRING, start_date DATE, end_date DATE, dimension1 STRING, "
    "value1 STRING, dimension2 STRING",
}


#: Partition column of a written star: filings are dealt into a fixed number of buckets.
BUCKET, BUCKETS = "filing_bucket", 16


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("filing_id"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Star:
    """Seven DataFrames, one row group per filing."""

    role: DataFrame
    presentation: DataFrame
    calculation: DataFrame
    element: DataFrame
    label: DataFrame
    fact: DataFrame
    context: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Star":
        """Read a star written by :meth:`write`; explicit schemas, no inference job."""
        return cls(**{name: _table(spark, path, name).drop(BUCKET) for name in SCHEMAS})

    @classmethod
    def read_filings(cls, spark: SparkSession, path: str, filings: DataFrame, tables: tuple[str, ...] = ()) -> "Star":
        """The star of the given ``filing_id`` rows only; folders of other buckets are not opened.

        The driver sees the buckets of the filings, of which there is a fixed number. If ``tables`` names some, the others
        are not looked for and have no rows.
        """
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        wanted = [r[0] for r in filings.select(_bucket(buckets)).distinct().collect() if r[0] is not None]
        return cls(**{
            name: _table(spark, path, name).filter(F.col(BUCKET).isin(wanted)).drop(BUCKET)
            if not tables or name in tables else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()
        }).only(filings)

    def write(self, path: str, mode: str = "overwrite", buckets: int = BUCKETS, tables: tuple[str, ...] = ()) -> None:
        """Write each table as Parquet, partitioned by bucket of filings and sorted by filing inside.

        A large bucket is split over several tasks and files. ``tables`` narrows the choice.
        """
        for name in tables or SCHEMAS:
            table: DataFrame = getattr(self, name)
            spark = table.sparkSession
            (table.select(*column_names(name), _bucket(buckets).alias(BUCKET))
             .hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "filing_id")
             .write.mode(mode).partitionBy(BUCKET).parquet(f"{path}/{name}"))
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")

    def replace(self, path: str, filings: DataFrame, batch: str) -> list[int]:
        """Put this star's rows of ``filings`` (filing_id) in place of what ``path`` holds of them; returns the buckets.

        Filings without rows here are taken out. Buckets of other filings keep their files; see ``replace_rows`` for what happens
        when ``batch`` is repeated. A path without a star gets one.
        """
        spark = self.fact.sparkSession
        if not path_exists(spark, f"{path}/layout"):
            spark.range(1).select(F.lit(BUCKETS).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        only = self.only(filings)
        fresh = {f.name: getattr(only, f.name).select(*column_names(f.name)) for f in fields(self)}
        return replace_rows(spark, path, fresh, filings, ["filing_id"], BUCKET, _bucket(buckets), batch)

    def only(self, filings: DataFrame) -> "Star":
        """The same star for the given ``filing_id`` rows only."""
        keep = filings.select("filing_id").distinct()
        return Star(**{
            field.name: getattr(self, field.name).join(keep, "filing_id", "left_semi")
            for field in fields(self)
        })


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMAS[name]}, {BUCKET} INT").parquet(f"{path}/{name}")


def column_names(table: str) -> list[str]:
    return [part.split()[0] for part in SCHEMAS[table].split(", ")]
