"""Filing lists: newest per type, amendments, period keys, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytree.functions.periods import amended_period_key, period_key, period_year
from tallytree.functions.text import anchor, drop_literal, first_link, lacks
from tallytree.operators.firsts import first_per
from tallytree.operators.reshape import all_as_text

# How many filings of a type a list asks for, and the first year it covers.
NEWEST_PER_TYPE = {"10-K": 8, "10-Q": 24}
FIRST_YEAR = 2015
INSTANCE_TYPES = ["XML", "EX-101.INS"]
VIEWER_PREFIX = "/ix?doc="
SITE = "https://www.sec.gov"


def newest_per_type(
    filings: DataFrame, limits: dict[str, int] = NEWEST_PER_TYPE, company: str = "company_id"
) -> DataFrame:
    """The newest filings of each form type per company.

    Asking for ``10-K`` also finds ``10-K/A``; an amendment takes a place in the list.
    """
    wanted = F.lit(None).cast("string")
    for form in limits:
        wanted = F.when(F.col("type").startswith(form), F.lit(form)).otherwise(wanted)
    listed = filings.withColumn("_form", wanted).filter("_form IS NOT NULL")
    limit = F.lit(0)
    for form, n in limits.items():
        limit = F.when(F.col("_form") == form, F.lit(n)).otherwise(limit)
    newest = Window.partitionBy(company, "_form").orderBy(F.desc("filing_date"), "href")
    # The literal bound lets Spark cut each group before the shuffle, the column bound is exact.
    return (
        listed.withColumn("_place", F.row_number().over(newest))
        .filter(F.col("_place") <= max(limits.values()))
        .filter(F.col("_place") <= limit).drop("_form", "_place")
    )


def with_type_prefix(filings: DataFrame, prefix: str = "10-") -> DataFrame:
    return filings.filter(F.col("type").startswith(prefix))


def without_amendments(filings: DataFrame) -> DataFrame:
    return filings.filter(lacks("type", "A"))


def filing_list(
    filings: DataFrame, limits: dict[str, int] = NEWEST_PER_TYPE, company: str = "company_id"
) -> DataFrame:
    """The list a user picks from: newest per type, then no amendments, with the period key."""
    return without_amendments(newest_per_type(filings, limits, company)).withColumn(
        "period", period_key("filing_date")
    )


def with_period(filings: DataFrame) -> DataFrame:
    """Period key with the amendment suffix, and the year it belongs to."""
    return filings.withColumns({
        "period": amended_period_key("filing_date", "type"),
        "period_year": period_year("filing_date"),
    })


def first_per_period(
    filings: DataFrame, company: str = "company_id", first_year: int = FIRST_YEAR
) -> DataFrame:
    """One filing per company and period, the newest, from ``first_year`` on."""
    recent = with_period(filings).filter(F.col("period_year") >= first_year)
    return first_per(recent, [company, "period"], [F.desc("filing_date"), "href"])


def instance_documents(documents: DataFrame, types: list[str] = INSTANCE_TYPES) -> DataFrame:
    """The first instance document of every filing."""
    found = documents.filter(F.col("doc_type").isin(types))
    return first_per(found, ["filing_href"], ["doc_seq", "doc_href"]).select("filing_href", "doc_href")


def cleaned(column: Column, patterns: list[str] | None = None) -> Column:
    """A column as text without the viewer name and white space."""
    text = column.cast("string")
    for pattern in patterns or ["iXBRL", r"\s+"]:
        text = F.regexp_replace(text, pattern, "")
    return text


def clean_text(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Every column as text with the viewer name and all white space removed."""
    text = all_as_text(df)
    return text.select(*[cleaned(F.col(f"`{c}`"), patterns).alias(c) for c in text.columns])


def document_link(html: Column | str, container: str = "table", site: str = SITE) -> Column:
    """Absolute link of the first document on a filing page, without the viewer prefix."""
    return drop_literal(F.concat(F.lit(site), first_link(html, container)), VIEWER_PREFIX)


def with_links(filings: DataFrame, pages: DataFrame, container: str = "table") -> DataFrame:
    """Filings with the link of their page (``pages``: href, html). One bulk join, no calls."""
    links = pages.select("href", document_link("html", container).alias("url"))
    return filings.join(links, "href", "left").withColumn("report", anchor("url", "type"))


def attach_company(filings: DataFrame, company: DataFrame, key: str = "company_id") -> DataFrame:
    """Company columns by key. Spark broadcasts the company side if its size allows."""
    return filings.join(company, key)


def filing_table(
    filings: DataFrame, company: DataFrame, pages: DataFrame, limits: dict[str, int] = NEWEST_PER_TYPE, container: str = "table"
) -> DataFrame:
    """company, period, filing_date, type, href, report: the list a user sees, one row per filing.

    ``company``: company_id, company. ``pages``: href, html. All texts are cleaned but the link.
    """
    listed = attach_company(with_links(filing_list(filings, limits), pages, container), company)
    return listed.select(
        *[cleaned(F.col(c)).alias(c) for c in ("company", "period", "filing_date", "type", "href")], "report")
