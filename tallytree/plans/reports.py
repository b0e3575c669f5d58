"""The four reports over all filings at once, in long form.

One row per printed line and period that has a value. ``section`` and ``el_order`` give the
display order; ``tallytree.operators.reshape`` turns the rows of a filing into a wide table. The three statements
go through the same steps at once, as units ``bs``, ``is`` and ``cf`` of every filing: one walk of the trees, one join with
the facts, one with the labels and one with the totals. A single statement is the same with one unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallytree.functions.numbers import sum_or_zero, units_label
from tallytree.functions.periods import period_label
from tallytree.functions.text import drop_literal
from tallytree.operators import facts as f
from tallytree.operators import labels as lab
from tallytree.operators import layout as lay
from tallytree.operators import roles as r
from tallytree.operators.reshape import sum_by_label
from tallytree.operators.tree import UNIT, tree_lines
from tallytree.session import pin
from tallytree.star import Star

MEMBER_SUFFIX = "[Member]"

# The one filer whose revenue is tagged with a list element.
REVENUE_OVERRIDES = [
    (
        "WLL",
        "us-gaap_RevenueFromContractWithCustomerProductAndServiceExtensibleList",
        "us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax",
    ),
]


def revenue_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REVENUE_OVERRIDES, "ticker STRING, element_id STRING, replacement STRING"
    )


#: Unit and name of the statements.
STATEMENTS = {"bs": "balance_sheet", "is": "income_statement", "cf": "cash_flow"}


def _order_mode() -> Column:
    """A balance sheet orders its arcs as text."""
    return F.when(F.col("unit") == "bs", "text").otherwise("numeric")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _units(star: Star, chosen: list[str]) -> DataFrame:
    """(filing_id, role_id, unit) of the chosen statements."""
    roles = {
        "bs": lambda: r.balance_roles(star.role),
        "is": lambda: r.first_role(r.income_roles(star.role)),
        "cf": lambda: r.first_role(r.cash_flow_roles(star.role)),
    }
    return _union([r.as_units(roles[unit](), unit) for unit in chosen])


def _of(df: DataFrame, unit: str) -> DataFrame:
    return df.filter(F.col("unit") == unit)


def _lines(
    star: Star, units: DataFrame, chosen: list[str], overrides: DataFrame | None, filing_ticker: DataFrame | None
) -> DataFrame:
    """Lines of the statements: balance sheets laid out in sections, income statements with the exceptions of single filers."""
    lines = tree_lines(r.arcs_in_units(star.presentation, units), order_mode=_order_mode(), with_path=False)
    parts = {unit: _of(lines, unit) for unit in chosen}
    if "bs" in parts:
        parents = lay.line_parents(_of(r.arcs_in_units(star.calculation, units), "bs"), star.label)
        parts["bs"] = lay.layout_sections(lay.lines_with_parents(parts["bs"], parents))
    if "is" in parts and overrides is not None:
        parts["is"] = f.override_elements(parts["is"], overrides, filing_ticker)
    return _union(list(parts.values()))


def _rows(facts: DataFrame, chosen: list[str]) -> DataFrame:
    """Facts that a statement may show, with its period and value: one per fact, or the first per element and fact."""
    def flow(rows: DataFrame) -> DataFrame:
        return f.first_facts(rows.withColumn("period", period_label("start_date", "end_date")))

    def balance() -> DataFrame:
        rows = _of(facts, "bs").filter(f.balance_dimensions()).withColumns({
            "element_id": f.member_as_line(f.LIABILITY_MEMBER), "period": F.col("end_date").cast("string")})
        return f.distinct_facts(rows, [*UNIT, *f.LINE, "context_id", "period", "fact", "decimals"])

    def income() -> DataFrame:
        return flow(_of(facts, "is").filter(f.income_dimensions()).withColumn("element_id", f.member_as_line(f.MEMBER)))

    def cash() -> DataFrame:
        return flow(_of(facts, "cf").filter(f.no_dimension()))

    build = {"bs": balance, "is": income, "cf": cash}
    columns = [*UNIT, *f.LINE, "fact_seq", "context_id", "fact", "decimals", "period"]
    return _union([f.with_value(build[unit]().select(*columns)) for unit in chosen])


def _cells(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """Cells of the dominant periods: sums, or the first value that is reported."""
    # A few rows per report, so the rows meet them without a shuffle wherever they are small enough.
    periods = pin(f.dominant_periods(rows).select(*UNIT, "period"), "statement-periods")
    kept = rows.join(periods, [*UNIT, "period"], "left_semi")
    build = {
        "bs": lambda: f.summed_cells(f.first_facts(_of(kept, "bs"))),
        "is": lambda: f.single_cells(f.first_facts(f.drop_infinite(_of(kept, "is")), by="value")),
        "cf": lambda: f.first_line(f.single_cells(_of(kept, "cf"))),
    }
    return _union([build[unit]() for unit in chosen])


def _shown(cells: DataFrame, chosen: list[str]) -> DataFrame:
    """Cells of the lines that are printed: repeated and misplaced lines go. Cash flows print what they have."""
    parts = []
    if "cf" in chosen:
        parts.append(_of(cells, "cf"))
    if set(chosen) - {"cf"}:
        others = cells.filter("unit <> 'cf'")
        keyed = f.row_keys(others, f.last_two_periods(others))
        if "is" in chosen:
            keyed = f.most_precise(keyed, only=F.col("unit") == "is")
        kept = f.rename_members(f.drop_repeated_rows(f.first_line(keyed)))
        parts.append(lay.drop_misplaced(kept, only=F.col("unit") == "bs"))
    return _union([part.select(*parts[0].columns) for part in parts])


def _labelled(star: Star, units: DataFrame, shown: DataFrame, chosen: list[str]) -> DataFrame:
    """Printed cells with label and kind of calculation; a line of a balance sheet without any label is left out.

    Balance sheets print a line once per label of the best choice, the others have one label.
    """
    ranked = lab.ranked_labels(shown, star.presentation, units, star.label)
    if len(chosen) > 1:
        ranked = pin(ranked, "statement-labels", by=["unit"])
    names = []
    if "bs" in chosen:
        names.append(lab.best_choice(_of(ranked, "bs")))
    if set(chosen) - {"bs"}:
        names.append(lab.first_choice(ranked.filter("unit <> 'bs'")))
    named = pin(_union(names), "statement-names").withColumn("named", F.lit(True))
    totals = lab.calculation_parents(star.calculation, units)
    return (
        shown.join(named, [*UNIT, "element_id"], "left")
        .filter((F.col("unit") != "bs") | F.col("named").isNotNull())
        .join(totals, [*UNIT, "element_id"], "left")
    )


def _balance_report(labelled: DataFrame) -> DataFrame:
    return (
        labelled.groupBy(*UNIT, "element_id", "label_string", "arcrole", "period")
        .agg(sum_or_zero("value").alias("value"), F.min(F.struct("section", "el_order")).alias("place"))
        .select(
            "filing_id", "place.section", "place.el_order", "element_id",
            lab.total_label("label_string", "arcrole").alias("label"),
            F.col("arcrole").isNotNull().alias("is_total"), "period", "value",
        )
    )


def _income_report(labelled: DataFrame) -> DataFrame:
    plain = labelled.withColumn("label", drop_literal("label_string", MEMBER_SUFFIX))
    return sum_by_label(plain, UNIT, ["arcrole", "period"]).select(
        "filing_id", "el_order", lab.total_label("label", "arcrole", by_word=True).alias("label"),
        F.col("arcrole").isNotNull().alias("is_total"), "period", "value",
    )


def _cash_report(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        "filing_id", "el_order", "element_id",
        lab.total_label("label_string", "arcrole").alias("label"),
        F.col("arcrole").isNotNull().alias("is_total"), "period", "value",
    )


def _statements(
    star: Star, chosen: list[str], overrides: DataFrame | None = None, filing_ticker: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The chosen statements by unit. What a step hands on is written once, by unit, and each unit reads its own part."""
    units = pin(_units(star, chosen), "statement-units")
    lines = _lines(star, units, chosen, overrides, filing_ticker)
    # Facts need a period. Filters on dimensions move below the join where one statement is asked for.
    facts = f.line_facts(lines, star.fact, star.context.filter(F.col("end_date").isNotNull()))
    if len(chosen) > 1:
        facts = pin(facts, "statement-facts", by=["unit"])
    rows = pin(_rows(facts, chosen), "statement-rows", by=["unit"])
    cells = pin(_cells(rows, chosen), "statement-cells", by=["unit"])
    shown = pin(_shown(cells, chosen), "statement-shown", by=["unit"])
    labelled = _labelled(star, units, shown, chosen)
    print_as = {"bs": _balance_report, "is": _income_report, "cf": _cash_report}
    return {unit: print_as[unit](_of(labelled, unit)) for unit in chosen}


def balance_sheet(star: Star) -> DataFrame:
    """filing_id, section, el_order, element_id, label, is_total, period, value."""
    return _statements(star, ["bs"])["bs"]


def income_statement(star: Star, overrides: DataFrame | None = None, filing_ticker: DataFrame | None = None) -> DataFrame:
    """filing_id, el_order, label, is_total, period, value; equal labels are added up.

    ``overrides`` (ticker, element_id, replacement) needs ``filing_ticker`` (filing_id, ticker).
    """
    return _statements(star, ["is"], overrides, filing_ticker)["is"]


def cash_flow(star: Star) -> DataFrame:
    """filing_id, el_order, element_id, label, is_total, period, value; missing values stay NULL."""
    return _statements(star, ["cf"])["cf"]


def disclosure_table(star: Star, roles: DataFrame | None = None) -> DataFrame:
    """All details tables: filing_id, role_id, title, element_id, label, is_total, units, period, value.

    ``roles`` narrows the choice. A role without usable facts yields no rows.
    """
    units = r.as_units(r.details_roles(star.role) if roles is None else roles)
    lines = tree_lines(r.arcs_in_units(star.presentation, units), order_mode="text", with_path=False)
    context = star.context.filter(F.col("end_date").isNotNull()).withColumn("period", F.col("end_date"))
    facts = star.fact.filter(F.col("fact").isNotNull())
    rows = pin(f.line_facts(lines, facts, context).select(
        *UNIT, *f.LINE, "fact_seq", "context_id", "fact", "decimals", "period"
    ), "disclosure-facts")
    cells = pin(f.summed_cells(f.with_value(f.first_facts(rows))), "disclosure-cells")
    names = pin(lab.preferred_in_unit(cells, star.presentation, units, star.label), "disclosure-names")
    totals = lab.calculation_parents(star.calculation, units)
    titles = lab.disclosure_titles(star.presentation, units, star.label).select(*UNIT, "title")
    return (
        # Every arc that labels a line prints it once more, and equal prints are added up.
        cells.join(names, [*UNIT, "element_id"])
        .join(totals, [*UNIT, "element_id"], "left")
        .withColumn("units", units_label("decimals"))
        .groupBy(*UNIT, "element_id", "label_string", "arcrole", "units", "period")
        .agg(sum_or_zero("value").alias("value"))
        .join(titles, UNIT)
        .select(
            "filing_id", F.col("unit").alias("role_id"), "title", "element_id",
            F.col("label_string").alias("label"), F.col("arcrole").isNotNull().alias("is_total"),
            "units", F.col("period").cast("string").alias("period"), "value",
        )
    )


def statement_lines(
    star: Star, overrides: DataFrame | None = None, filing_ticker: DataFrame | None = None
) -> DataFrame:
    """The three statements in one long table with the column ``statement``; every step runs once for all of them."""
    shared = ["filing_id", "section", "el_order", "element_id", "label", "is_total", "period", "value"]
    missing = {"section": F.lit(0), "element_id": F.lit(None).cast("string")}
    parts = []
    for unit, part in _statements(star, list(STATEMENTS), overrides, filing_ticker).items():
        part = part.withColumns({c: e for c, e in missing.items() if c not in part.columns})
        parts.append(part.select(F.lit(STATEMENTS[unit]).alias("statement"), *shared))
    return _union(parts)
