import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallytree.operators import facts as f, filings as fil, labels as lab, layout as lay, reshape as rs, roles as r

from conftest import rows

ROLE = "filing_id BIGINT, role_seq BIGINT, role_id STRING, type STRING, description STRING"


def test_role_selection_and_fallback(spark):
    role = spark.createDataFrame([
        (1, 1, "x", "Statement", None),
        (1, 2, "ci", "Statement", "Comprehensive Income"),
        (2, 1, "ci", "Statement", "COMPREHENSIVE INCOME"),
        (2, 2, "is", "Statement", "Statements of Operations"),
        (2, 3, "isp", "Statement", "Statements of Operations (Parenthetical)"),
        (2, 4, "d", "Disclosure", "Income Taxes (Details)"),
        (2, 5, "m", "Statement", "iNCOME"),
    ], ROLE)
    assert rows(r.income_roles(role), "filing_id", "role_id") == [(1, "ci"), (2, "is")]
    assert rows(r.first_role(role), "filing_id", "role_id") == [(1, "x"), (2, "ci")]
    assert rows(r.details_roles(role), "role_id") == [("d",)]


CELL = "filing_id BIGINT, unit STRING, section INT, el_order BIGINT, level2 STRING, element_id STRING, decimals STRING, period STRING, value DOUBLE"


def test_repeated_rows_and_single_period(spark):
    cells = spark.createDataFrame([
        (1, "u", 0, 1, "A", "a", "0", "2018", 5.0), (1, "u", 0, 1, "A", "a", "0", "2019", 6.0),
        (1, "u", 0, 2, "A", "b", "0", "2018", 5.0), (1, "u", 0, 2, "A", "b", "0", "2019", 6.0),
        (1, "u", 0, 3, "B", "c", "0", "2018", 5.0), (1, "u", 0, 3, "B", "c", "0", "2019", 6.0),
        (1, "u", 0, 4, "A", "d", "0", "2017", 5.0),
        (2, "u", 0, 1, "A", "a", "0", "2018", 5.0),
        (2, "u", 0, 2, "A", "b", "0", "2018", 5.0),
    ], CELL)
    columns = f.last_two_periods(cells)
    assert rows(columns) == [(1, "u", "2019", "2018"), (2, "u", "2018", None)]
    kept = f.drop_repeated_rows(f.first_line(f.row_keys(cells, columns)))
    assert rows(kept.select("filing_id", "element_id").distinct()) == [(1, "a"), (1, "c"), (1, "d"), (2, "a")]


def test_most_precise_drops_elements_with_a_missing_decimal(spark):
    cells = spark.createDataFrame([
        (1, "u", 0, 1, "A", "a", "-3", "p", 1.0), (1, "u", 0, 1, "A", "a", "-2", "p", 2.0),
        (1, "u", 0, 2, "A", "b", None, "p", 1.0), (1, "u", 0, 2, "A", "b", "-2", "p", 2.0),
    ], CELL)
    assert rows(f.most_precise(cells), "element_id", "decimals") == [("a", "-2")]
    assert rows(f.first_line(cells), "element_id", "decimals") == [("a", "-2"), ("b", "-2")]


def test_dominant_periods_keep_exactly_half(spark):
    data = [(1, "u", "a")] * 4 + [(1, "u", "b")] * 2 + [(1, "u", "c")] + [(2, "u", "c")]
    df = spark.createDataFrame(data, "filing_id BIGINT, unit STRING, period STRING")
    assert rows(f.dominant_periods(df), "filing_id", "period", "n_rows") == [(1, "a", 4), (1, "b", 2), (2, "c", 1)]


FACT = "filing_id BIGINT, unit STRING, section INT, el_order BIGINT, level2 STRING, element_id STRING, fact_seq BIGINT, context_id STRING, fact STRING, decimals STRING, period STRING"


def test_equal_value_in_second_period_leaves_a_hole(spark):
    df = spark.createDataFrame([
        (1, "u", 0, 1, "A", "a", 1, "c1", "5", "0", "2018"), (1, "u", 0, 1, "A", "a", 2, "c2", "5", "0", "2019"),
        (1, "u", 0, 1, "A", "a", 3, "c3", "7", "0", "2019"),
    ], FACT)
    assert rows(f.first_facts(df), "fact", "period") == [("5", "2018"), ("7", "2019")]
    assert f.first_facts_per_period(df).count() == 3
    summed = f.summed_cells(f.with_value(df))
    assert rows(summed, "period", "value") == [("2018", 5.0), ("2019", 12.0)]


def test_all_missing_sums_to_zero(spark):
    df = spark.createDataFrame([(1, "u", 0, 1, "A", "a", 1, "c", "x", "0", "p")], FACT)
    assert rows(f.summed_cells(f.with_value(df)), "value") == [(0.0,)]


def test_income_dimension_precedence(spark):
    df = spark.createDataFrame([
        ("a", None, None, None), ("b", "ProductAxis", "x:OilMember", None), ("c", "RegionAxis", "x:WestMember", None),
        ("d", "ScenarioAxis", "x:PredecessorMember", None), ("e", "ProductAxis", "x:OilMember", "LegalAxis"),
    ], "k STRING, dimension1 STRING, value1 STRING, dimension2 STRING")
    assert rows(df.filter(f.income_dimensions()), "k") == [("a",), ("b",), ("d",)]


def _label_star(spark):
    lines = spark.createDataFrame([(1, "u", e) for e in "abcd"], "filing_id BIGINT, unit STRING, element_id STRING")
    pres = spark.createDataFrame([
        (1, 1, "u", "R", "a", "1", "total"), (1, 2, "u", "R", "b", "2", None), (1, 3, "o", "R", "b", "1", "std"),
        (1, 4, "u", "R", "c", "3", "std"),
    ], "filing_id BIGINT, arc_seq BIGINT, role_id STRING, from_element_id STRING, to_element_id STRING, arc_order STRING, preferred_label STRING")
    label = spark.createDataFrame([
        (1, 1, "a", "std", "en-US", "A"), (1, 2, "a", "total", "en-US", "Total A"), (1, 3, "b", "std", "en-US", "B"),
        (1, 4, "c", "std", "fr", "C fr"), (1, 5, "c", "terse", "en-US", "C"),
    ], "filing_id BIGINT, label_seq BIGINT, element_id STRING, label_role STRING, lang STRING, label_string STRING")
    units = spark.createDataFrame([(1, "u", "u")], "filing_id BIGINT, role_id STRING, unit STRING")
    return lines, pres, units, label


def test_label_tiers(spark):
    want = [("a", "Total A", 1), ("b", "B", 2), ("c", "C fr", 3)]
    assert rows(lab.label_tiers(*_label_star(spark)), "element_id", "label_string", "tier") == want
    assert rows(lab.first_label(*_label_star(spark)), "element_id", "label_string", "tier") == want


def test_all_labels_of_a_choice_against_the_first(spark):
    """An element with several labels of its best choice keeps each text once, or the one of its first arc."""
    lines = spark.createDataFrame([(1, "u", "a"), (1, "u", "b")], "filing_id BIGINT, unit STRING, element_id STRING")
    units = spark.createDataFrame([(1, "u", "r1")], "filing_id BIGINT, unit STRING, role_id STRING")
    pres = spark.createDataFrame([
        (1, 1, "r1", "x", "a", "1", "terse"), (1, 2, "r1", "x", "a", "2", "plain"),
        (1, 3, "r2", "x", "b", "1", "plain"), (1, 4, "r2", "x", "b", "2", "terse"),
    ], "filing_id BIGINT, arc_seq BIGINT, role_id STRING, from_element_id STRING, to_element_id STRING, arc_order STRING, preferred_label STRING")
    label = spark.createDataFrame([
        (1, 1, "a", "plain", "en-US", "A"), (1, 2, "a", "terse", "en-US", "A short"), (1, 3, "a", "terse", "en-US", "A"),
        (1, 4, "b", "terse", "en-US", "B short"), (1, 5, "b", "plain", "en-US", "B"), (1, 6, "b", "plain", "fr", "B fr"),
    ], "filing_id BIGINT, label_seq BIGINT, element_id STRING, label_role STRING, lang STRING, label_string STRING")
    star, names = (lines, pres, units, label), ("element_id", "label_string", "tier")
    assert rows(lab.label_tiers(*star), *names) == [("a", "A", 1), ("a", "A short", 1), ("b", "B", 2), ("b", "B short", 2)]
    assert rows(lab.first_label(*star), *names) == [("a", "A short", 1), ("b", "B", 2)]


def test_missing_label_role_matches_missing_preference(spark):
    lines, pres, units, label = _label_star(spark)
    extra = spark.createDataFrame([(1, 9, "b", None, "en-US", "B without role")], label.schema)
    got = lab.label_tiers(lines, pres, units, label.union(extra)).filter("element_id = 'b'")
    assert rows(got, "label_string", "tier") == [("B without role", 1)]


def test_layout_gate_and_first_rule(spark):
    lines = spark.createDataFrame(
        [(1, "u", 0, i, e, "L", p) for i, (e, p) in enumerate([
            ("us-gaap_Cash", "us-gaap_AssetsCurrent"), ("us-gaap_InventoryNet", "us-gaap_AssetsCurrent"),
            ("us-gaap_Goodwill", "us-gaap_Assets"), ("x_Other", "x_Unknown"), ("us-gaap_Equity1", None)], start=1)]
        + [(2, "u", 0, i, f"e{i}", "L", None) for i in range(1, 6)],
        "filing_id BIGINT, unit STRING, section INT, el_order BIGINT, element_id STRING, level2 STRING, parent_id STRING")
    got = lay.layout_sections(lines)
    assert rows(got.filter("filing_id = 1"), "el_order", "section") == [(1, 1), (2, 1), (3, 7), (5, 17)]
    assert rows(got.filter("filing_id = 2"), "el_order", "section") == [(i, 0) for i in range(1, 6)]
    assert rows(lay.layout_order(got).filter("filing_id = 1"), "el_order", "line_no") == [(1, 1), (2, 2), (3, 3), (5, 4)]


def test_pivot(spark):
    long = spark.createDataFrame([(1, "a", "2018", 1.0), (1, "a", "2019", 2.0), (1, "b", "2019", None)],
                                 "filing_id BIGINT, label STRING, period STRING, value DOUBLE")
    wide = rs.pivot_periods(long, ["filing_id", "label"], check=True)
    assert wide.columns == ["filing_id", "label", "2018", "2019"]
    assert rows(wide) == [(1, "a", 1.0, 2.0), (1, "b", None, None)]
    assert rows(rs.pivot_sums(long, ["filing_id", "label"])) == [(1, "a", 1.0, 2.0), (1, "b", 0.0, 0.0)]
    with pytest.raises(rs.DuplicateCells):
        rs.pivot_periods(long.union(long), ["filing_id", "label"], check=True)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`level1` INT, Level2 INT, `3 Months ended` INT, d INT")
    assert rs.select_matching(df, "months").columns == ["3 Months ended"]
    assert rs.select_matching(df, "level").columns == ["level1", "Level2"]
    assert rs.drop_matching(df, "level").columns == ["Level2", "3 Months ended", "d"]
    assert rs.rename_first(df, "a", "b").columns == ["a", "b", "3 Months ended", "d"]
    assert rs.pick_positions(df, -2, -1).columns == ["3 Months ended", "d"]


def test_filing_lists(spark):
    day = dt.date
    df = spark.createDataFrame([
        (1, day(2019, 2, 1), "10-K", "/a"), (1, day(2019, 3, 1), "10-K/A", "/b"), (1, day(2018, 2, 1), "10-K", "/c"),
        (1, day(2019, 5, 1), "10-Q", "/d"), (1, day(2014, 5, 1), "10-Q", "/e"), (1, day(2019, 5, 2), "8-K", "/f"),
    ], "company_id BIGINT, filing_date DATE, type STRING, href STRING")
    # The amendment takes one of the two annual places before it is left out.
    assert rows(fil.filing_list(df, {"10-K": 2, "10-Q": 3}), "href", "period") == [("/a", "Q42018"), ("/d", "Q12019"), ("/e", "Q12014")]
    firsts = fil.first_per_period(fil.with_type_prefix(df))
    assert rows(firsts, "href", "period") == [("/a", "Q42018"), ("/b", "Q42018A"), ("/c", "Q42017"), ("/d", "Q12019")]


def test_clean_text_touches_every_column(spark):
    df = spark.createDataFrame([("10-K iXBRL", " A B ")], "type STRING, company STRING")
    assert rows(fil.clean_text(df)) == [("10-K", "AB")]


def test_override_applies_to_its_ticker_only(spark):
    lines = spark.createDataFrame([(1, "u", "old"), (2, "u", "old"), (1, "u", "x")], "filing_id BIGINT, unit STRING, element_id STRING")
    overrides = spark.createDataFrame([("T", "old", "new")], "ticker STRING, element_id STRING, replacement STRING")
    tickers = spark.createDataFrame([(1, "T"), (2, "S")], "filing_id BIGINT, ticker STRING")
    assert rows(f.override_elements(lines, overrides, tickers), "filing_id", "element_id") == [(1, "new"), (1, "x"), (2, "old")]
