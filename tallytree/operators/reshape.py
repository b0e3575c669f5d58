"""Wide display forms and column picks by name or position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallytree.functions.numbers import sum_or_zero
from tallytree.session import pin


class DuplicateCells(ValueError):
    """Two values compete for one cell of a wide report."""


def period_values(long: DataFrame, period: str = "period") -> list[str]:
    """The distinct periods of the rows to display, as text, in text order.

    They become columns, so their number must stay small: more than Spark's own pivot limit
    is an error, not a truncation.
    """
    limit = int(long.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = long.select(F.col(period).cast("string").alias("p")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} periods to pivot; filter to one filing or one year")
    return sorted(row.p for row in rows if row.p is not None)


def pivot_periods(
    long: DataFrame, keys: list[str], periods: list[str] | None = None,
    value: str = "value", period: str = "period", check: bool = False,
) -> DataFrame:
    """One row per line, one column per period, NULL where a line has no value.

    With ``check`` a second value for a cell raises before anything is shown.
    """
    if check and not long.groupBy(*keys, period).count().filter("count > 1").isEmpty():
        raise DuplicateCells(f"several values per {keys} and {period}")
    names = periods if periods is not None else period_values(long, period)
    text = long.withColumn(period, F.col(period).cast("string"))
    return text.groupBy(*keys).pivot(period, names).agg(F.first(value))


def pivot_sums(
    long: DataFrame, keys: list[str], periods: list[str] | None = None,
    value: str = "value", period: str = "period",
) -> DataFrame:
    """Wide sums per key; a key without a value in a period shows zero."""
    names = periods if periods is not None else period_values(long, period)
    text = long.withColumn(period, F.col(period).cast("string"))
    wide = text.groupBy(*keys).pivot(period, names).agg(F.sum(value))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


def sum_by(long: DataFrame, keys: list[str], value: str = "value", out: str = "value") -> DataFrame:
    """Sum per key where a group of missing values only gives zero."""
    return long.groupBy(*keys).agg(sum_or_zero(value).alias(out))


def order_by_label(lines: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Each line with the earliest place of its label: a partial aggregate joined back."""
    place = F.min(F.struct("section", "el_order")).alias("_place")
    first = lines.groupBy(*keys, label).agg(place)
    match = F.col(f"l.{label}").eqNullSafe(F.col(f"f.{label}"))
    for key in keys:
        match = match & (F.col(f"l.{key}") == F.col(f"f.{key}"))
    kept = [F.col(f"l.{c}") for c in lines.columns if c not in ("section", "el_order")]
    return lines.alias("l").join(first.alias("f"), match).select(
        *kept, F.col("f._place.section").alias("section"), F.col("f._place.el_order").alias("el_order")
    )


def sum_by_label(lines: DataFrame, keys: list[str], detail: list[str], label: str = "label") -> DataFrame:
    """Sum of lines with equal label and detail, at the earliest place of the label.

    The sums combine before the shuffle; the window sees one row per label and detail.
    """
    place = F.min(F.struct("section", "el_order"))
    totals = lines.groupBy(*keys, label, *detail).agg(
        sum_or_zero("value").alias("value"), place.alias("_place")
    )
    first = F.min("_place").over(Window.partitionBy(*keys, label))
    return totals.withColumn("_place", first).select(
        *keys, label, *detail, "value", "_place.section", "_place.el_order"
    )


def display(
    lines: DataFrame, header: str, detail: list[str] | None = None, periods: list[str] | None = None, filing: str = "filing_id"
) -> DataFrame:
    """A report as it is printed: filing, ``header`` with the labels, place, detail columns, one column per period.

    Lines of one label and detail are added up at their earliest place. The rows of a filing are in
    order of (section, el_order) when written or collected; ``periods`` defaults to those of the lines.
    """
    keys, detail = [filing, "label"], detail or []
    lines = pin(lines, "printed-lines")  # read for places, values and periods
    place = lines.groupBy(*keys, *detail).agg(F.min(F.struct("section", "el_order")).alias("_place"))
    wide = pivot_sums(lines, [*keys, *detail], periods)
    place = place.toDF(*[f"_{c}" for c in [*keys, *detail]], "_place")
    match = F.lit(True)
    for c in [*keys, *detail]:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    shown = [_quoted(c) for c in wide.columns if c not in keys and c not in detail]
    printed = wide.join(place, match).select(
        *keys, F.col("_place.section").alias("section"), F.col("_place.el_order").alias("el_order"), *detail, *shown)
    return rename_first(printed, filing, header).sort(filing, "section", "el_order", _quoted(header))


def most_periods(lines: DataFrame, filing: str = "filing_id", period: str = "period") -> int:
    """Periods of the filing that has the most; the only number that the driver sees."""
    counts = lines.select(filing, F.col(period).cast("string")).distinct().groupBy(filing).count()
    return counts.agg(F.max("count")).first()[0] or 0


def display_by_rank(
    lines: DataFrame, header: str, detail: list[str] | None = None, columns: int | None = None, filing: str = "filing_id"
) -> DataFrame:
    """Reports of many filings as they are printed, with as many columns as one filing has periods.

    ``value_1`` .. are the values of the first, second .. period of the own filing, in text order. A header row per filing
    (``is_header``) names these periods in ``period_1`` .. and has ``header`` as its label; the lines follow by section and
    el_order. Lines of one label and detail are added up, missing values are 0 where the filing has the period and NULL where it
    has none. ``columns`` fixes the number of columns; a filing with more periods raises.
    """
    detail = detail or []
    lines = pin(lines, "printed-lines")  # read for values, ranks and heads
    n = most_periods(lines, filing) if columns is None else columns
    text = lines.withColumn("period", F.col("period").cast("string"))
    ranked = text.select(filing, "period").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy(filing).orderBy("period")))
    too_many = F.raise_error(F.lit(f"a filing has more than {n} periods")).cast("int")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")).otherwise(too_many))
    ranks = list(range(1, n + 1))
    at = lambda value, k: F.max(F.when(F.col("rank") == k, value))
    heads = ranked.groupBy(filing).agg(*(at(F.col("period"), k).alias(f"period_{k}") for k in ranks))
    keys = [filing, "label", *detail]
    sums = text.groupBy(*keys, "period").agg(sum_or_zero("value").alias("value"), F.min(F.struct("section", "el_order")).alias("_place"))
    body = sums.join(ranked, [filing, "period"]).groupBy(*keys).agg(
        F.min("_place").alias("_place"), *(at(F.col("value"), k).alias(f"_{k}") for k in ranks))
    shown = [F.when(F.col(f"period_{k}").isNotNull(), F.coalesce(f"_{k}", F.lit(0.0))).alias(f"value_{k}") for k in ranks]
    body = body.join(heads, filing).select(
        filing, "label", F.lit(False).alias("is_header"), "_place.section", "_place.el_order", *detail,
        *(F.lit(None).cast("string").alias(f"period_{k}") for k in ranks), *shown)
    top = heads.select(
        filing, F.lit(header).alias("label"), F.lit(True).alias("is_header"),
        *(F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("section", "el_order", *detail)),
        *(f"period_{k}" for k in ranks), *(F.lit(None).cast("double").alias(f"value_{k}") for k in ranks))
    return top.unionByName(body)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_matching(df: DataFrame, *parts: str) -> DataFrame:
    """Columns whose name contains one of the texts, whatever the case."""
    lowered = [p.lower() for p in parts]
    return df.select(*[_quoted(c) for c in df.columns if any(p in c.lower() for p in lowered)])


def drop_matching(df: DataFrame, part: str) -> DataFrame:
    """All columns but those whose name contains the text."""
    return df.select(*[_quoted(c) for c in df.columns if part not in c])


def rename_first(df: DataFrame, *names: str) -> DataFrame:
    """New names for the first columns, the rest keep theirs."""
    return df.toDF(*names, *df.columns[len(names):])


def pick_positions(df: DataFrame, *positions: int) -> DataFrame:
    """Columns by position, 0-based, negative from the end."""
    return df.select(*[_quoted(df.columns[p]) for p in positions])


def all_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[_quoted(c).cast("string").alias(c) for c in df.columns])


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
