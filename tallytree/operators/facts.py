"""From report lines to valued cells.

Group sizes decide the form of each step. Counts and sums over a filing or a period are
aggregates joined back, never windows. Windows run only on cells, of which an element has at
most one per line, precision and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytree.functions.numbers import is_finite_or_null, scale_fact, sum_or_zero, to_double
from tallytree.functions.text import has, underscore_ids
from tallytree.operators.firsts import first_per, leading_ties, top_n_per
from tallytree.operators.tree import UNIT

# Document order of facts inside a line; the context settles ties.
FACT_ORDER = ["section", "el_order", "fact_seq", "context_id"]
# What identifies a line besides its report: display section, tree place, branch and element.
LINE = ["section", "el_order", "level2", "element_id"]

# Member and axis words that decide which dimensional facts belong to a statement.
LIABILITY_MEMBER = "OtherCurrentL"
PREDECESSOR = "Predece"
SUCCESSOR = "Success"
MEMBER = "Member"
PRODUCT_AXIS = "Product"


def no_dimension() -> Column:
    """Facts of the reporting entity as a whole."""
    return F.col("dimension1").isNull()


def balance_dimensions() -> Column:
    return (
        no_dimension() | has("value1", LIABILITY_MEMBER) | has("value1", PREDECESSOR)
        | has("value1", SUCCESSOR)
    )


def income_dimensions() -> Column:
    product = has("value1", MEMBER) & has("dimension1", PRODUCT_AXIS)
    return (
        (no_dimension() | product | has("value1", PREDECESSOR) | has("value1", SUCCESSOR))
        & F.col("dimension2").isNull()
    )


def member_as_line(word: str) -> Column:
    """A member that contains the word takes the place of its element."""
    return F.when(has("value1", word), F.col("value1")).otherwise(F.col("element_id"))


def line_facts(
    lines: DataFrame, fact: DataFrame, context: DataFrame, how: str = "inner"
) -> DataFrame:
    """Facts of the given lines with their context; the context side is filtered beforehand.

    The reports need a period, so they join inner; ``how="left"`` keeps lines without facts.

    Lines come first because they keep the small share of facts that a statement shows. Both
    joins are equi-joins on a composite key, so AQE can split a hot key.
    """
    facts = fact.select("filing_id", "fact_seq", "element_id", "context_id", "fact", "decimals")
    return (
        lines.join(facts, ["filing_id", "element_id"], how)
        .join(context, ["filing_id", "context_id"], how)
    )


def override_elements(
    lines: DataFrame, overrides: DataFrame, filing_ticker: DataFrame
) -> DataFrame:
    """Replace listed elements for listed tickers.

    ``overrides``: ticker, element_id, replacement: a table of exceptions, a handful of rows.
    ``filing_ticker``: filing_id, ticker. Only filings with an exception join the lines.
    """
    swaps = filing_ticker.join(overrides, "ticker").select("filing_id", "element_id", "replacement")
    return (
        lines.join(swaps, ["filing_id", "element_id"], "left")
        .withColumn("element_id", F.coalesce("replacement", "element_id"))
        .select(*lines.columns)
    )


def period_counts(rows: DataFrame, keys: list[str] = UNIT, period: str = "period") -> DataFrame:
    """Rows per period with the largest count of the report.

    The counts combine before the shuffle; the window sees one row per period of a report.
    """
    counts = rows.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("max_rows", F.max("n_rows").over(Window.partitionBy(*keys)))


def dominant_periods(
    rows: DataFrame, keys: list[str] = UNIT, period: str = "period", share: float = 0.5
) -> DataFrame:
    """Periods with at least ``share`` of the rows of the largest period."""
    return (
        period_counts(rows, keys, period)
        .filter(F.col("n_rows") >= F.col("max_rows") * F.lit(share))
        .select(*keys, period, "n_rows")
    )


def keep_dominant(rows: DataFrame, keys: list[str] = UNIT, period: str = "period") -> DataFrame:
    """Rows of dominant periods. ``rows`` is read twice: pin it if it is costly."""
    return rows.join(dominant_periods(rows, keys, period), [*keys, period], "left_semi")


def distinct_facts(rows: DataFrame, content: list[str]) -> DataFrame:
    """Equal facts reported more than once count once; the earliest position stays."""
    return rows.groupBy(*content).agg(F.min("fact_seq").alias("fact_seq"))


def first_facts(rows: DataFrame, keys: list[str] = UNIT, by: str = "fact") -> DataFrame:
    """First row per element and value: an equal value in a later period leaves a hole."""
    return first_per(rows, [*keys, "element_id", by], FACT_ORDER)


def first_facts_per_period(rows: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Variant that keeps equal values of different periods."""
    return first_per(rows, [*keys, "element_id", "fact", "period"], FACT_ORDER)


def with_value(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", scale_fact("fact", "decimals"))


def drop_infinite(rows: DataFrame) -> DataFrame:
    return rows.filter(is_finite_or_null("value"))


def summed_cells(rows: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Cells that show the sum of their element and period on every line of the element.

    Values are summed per cell first, with map-side combine; the window then runs over the few
    cells of an element.
    """
    cells = rows.groupBy(*keys, *LINE, "decimals", "period").agg(
        F.sum("value").alias("_part")
    )
    whole = Window.partitionBy(*keys, "element_id", "period")
    return cells.withColumn("value", sum_or_zero_over("_part", whole)).drop("_part")


def sum_or_zero_over(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0.0))


def single_cells(rows: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Cells of reports that do not sum: the first reported value of a cell."""
    cell = [*keys, *LINE, "decimals", "period"]
    return first_per(rows, cell, ["fact_seq", "context_id"]).select(*cell, "value")


def most_precise(cells: DataFrame, keys: list[str] = UNIT, only: Column | None = None) -> DataFrame:
    """Rows with the highest decimals of their element; an element with a missing one is dropped.

    Rows that ``only`` does not choose all stay.
    """
    element = Window.partitionBy(*keys, "element_id")
    digits = to_double("decimals")
    return (
        cells.withColumn("_max", F.max(digits).over(element))
        .withColumn("_missing", F.count_if(digits.isNull()).over(element))
        .filter(((F.col("_missing") == 0) & (digits == F.col("_max"))) | (F.lit(False) if only is None else ~only))
        .drop("_max", "_missing")
    )


def first_line(cells: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """All cells of the first row of every element: by line, then decimals as text, missing last."""
    order = ["section", "el_order", F.col("decimals").asc_nulls_last()]
    return leading_ties(cells, [*keys, "element_id"], order)


def rename_members(cells: DataFrame) -> DataFrame:
    return cells.withColumn("element_id", underscore_ids("element_id"))


def last_two_periods(cells: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """The two last period columns of a report, in text order; ``period2`` is NULL if only one."""
    periods = cells.groupBy(*keys, F.col("period").cast("string").alias("period")).count()
    latest = top_n_per(periods, keys, [F.desc("period")], 2)
    return latest.groupBy(*keys).agg(
        F.max("period").alias("period1"),
        F.nullif(F.min("period"), F.max("period")).alias("period2"),
    )


def row_keys(cells: DataFrame, columns: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Cells with the values that their line shows in the last two period columns.

    Cells are one row per line and period here, so the window runs over a handful of rows; its
    partitioning also serves :func:`first_line`.
    """
    period = F.col("period").cast("string")
    line = Window.partitionBy(*keys, "element_id", "section", "el_order", "decimals")
    shown = [F.max(F.when(period == F.col(c), F.col("value"))).over(line) for c in ("period1", "period2")]
    return (
        cells.join(columns, keys)
        .repartition(*keys, "element_id")
        .withColumns({"last_value": shown[0], "second_last_value": shown[1]})
        .drop("period1", "period2")
    )


def drop_repeated_rows(cells: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Of lines with the same second level and the same last two values the first stays.

    ``cells`` comes from :func:`row_keys`; the cells of a line tie, so all of them stay.
    """
    same = [*keys, "level2", "last_value", "second_last_value"]
    kept = leading_ties(cells, same, ["section", "el_order", "element_id"])
    return kept.drop("last_value", "second_last_value")
