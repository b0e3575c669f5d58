"""Readers for filing lists, documents, pages, companies and prices.

All take a path and a format, so a landing folder of JSON or CSV reads like a Parquet table.
Schemas are explicit: no inference pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytree.operators.filings import NEWEST_PER_TYPE, newest_per_type, with_type_prefix
from tallytree.operators.reshape import rename_first

FILING_SCHEMA = "company_id BIGINT, filing_date DATE, type STRING, href STRING"
DOCUMENT_SCHEMA = "filing_href STRING, doc_seq BIGINT, doc_href STRING, doc_type STRING"
PAGE_SCHEMA = "href STRING, html STRING"
COMPANY_SCHEMA = "ticker STRING, company STRING"
PRICE_COLUMNS = ["ticker", "date", "opening", "high", "low", "closing"]

# The companies of the picker, ticker and operator.
COMPANIES = [
    ("APA", "Apache"),
    ("AR", "Antero Resources"),
    ("AREX", "Approach Resources"),
    ("BCEI", "Bonanza Creek Energy"),
    ("CDEV", "Centennial Resource Development"),
    ("CHAP", "Chaparral Energy"),
    ("CHK", "Chesapeake Energy"),
    ("CLR", "Continental Resources"),
    ("CNX", "CNX Resources"),
    ("COG", "Cabot Oil & Gas"),
    ("COP", "ConocoPhillips"),
    ("CPE", "Callon Petroleum"),
    ("CRK", "Comstock Resources"),
    ("CVX", "Chevron"),
    ("CXO", "Concho Resources"),
    ("DVN", "Devon Energy"),
    ("ECA", "Encana Corporation"),
    ("EOG", "EOG Resources"),
    ("EQT", "EQT Corporation"),
    ("ESTE", "Earthstone Energy"),
    ("FANG", "Diamondback Energy"),
    ("GPOR", "Gulfport Energy"),
    ("GDP", "Goodrich Petroleum"),
    ("HES", "Hess Corporation"),
    ("HPR", "HighPoint Resources"),
    ("LLEX", "Lilis Energy"),
    ("LPI", "Laredo Petroleum"),
    ("MGY", "Magnolia Oil & Gas Operating"),
    ("MR", "Montage Resources"),
    ("MRO", "Marathon Oil"),
    ("MTDR", "Matador Resources"),
    ("MUR", "Murphy Oil"),
    ("NBL", "Noble Energy"),
    ("OAS", "Oasis Petroleum"),
    ("OXY", "Occidental Petroleum"),
    ("PDCE", "PDC Energy"),
    ("PE", "Parsley Energy"),
    ("PVAC", "Penn Virginia Corporation"),
    ("PXD", "Pioneer Natural Resources"),
    ("QEP", "QEP Resources"),
    ("RRC", "Range Resources"),
    ("SBOW", "SilverBow Resources"),
    ("SM", "SM Energy"),
    ("SWN", "Southwestern Energy"),
    ("WLL", "Whiting Petroleum Corporation"),
    ("WPX", "WPX Energy"),
    ("XEC", "Cimarex Energy"),
    ("XOG", "Extraction Oil & Gas"),
    ("XOM", "ExxonMobil"),
]


def _read(spark: SparkSession, path: str, fmt: str, schema: str, **options: str) -> DataFrame:
    if fmt == "csv":
        options = {"header": "true", **options}
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def read_filing_index(
    spark: SparkSession, path: str, fmt: str = "parquet",
    limits: dict[str, int] | None = None, prefix: str | None = None,
) -> DataFrame:
    """Filing list: all of it, the newest per form type, or the types with a prefix."""
    filings = _read(spark, path, fmt, FILING_SCHEMA)
    if prefix is not None:
        filings = with_type_prefix(filings, prefix)
    if limits is not None:
        filings = newest_per_type(filings, limits)
    return filings


def read_newest_filings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The list with the usual limits: eight annual and twenty-four quarterly reports."""
    return read_filing_index(spark, path, fmt, limits=NEWEST_PER_TYPE)


def read_filing_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, DOCUMENT_SCHEMA)


def read_filing_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, PAGE_SCHEMA)


def read_companies(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, COMPANY_SCHEMA)


def known_companies(spark: SparkSession) -> DataFrame:
    """The fixed picker list (ticker, operator): a few dozen rows, small enough to broadcast."""
    return spark.createDataFrame(COMPANIES, "ticker STRING, operator STRING")


def tickers_of(companies: DataFrame, operator: str) -> DataFrame:
    return companies.filter(F.col("operator") == operator).select("ticker")


def read_prices(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Daily prices whose first six columns are ticker, date and the four prices in order."""
    wide = "c0 STRING, c1 DATE, c2 DOUBLE, c3 DOUBLE, c4 DOUBLE, c5 DOUBLE"
    prices = _read(spark, path, fmt, wide, enforceSchema="true")
    return rename_first(prices, *PRICE_COLUMNS)
