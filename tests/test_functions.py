import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallytree.functions import numbers as num, periods as per, text as txt

from conftest import rows


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


def test_missing_text_contains_nothing_and_lacks_everything(spark):
    df = spark.createDataFrame([("Cash",), ("cASH",), (None,)], "t STRING")
    out = df.select("t", txt.has_any("t", ["CASH", "Cash", "cash"]).alias("h"), txt.lacks("t", "as").alias("l"))
    assert rows(out) == sorted([("Cash", True, False), ("cASH", False, True), (None, False, True)], key=lambda t: (t[0] is None, str(t[0])))


def test_paste_prints_missing_as_na(spark):
    assert one(spark, txt.paste("a", F.lit("-"), "b"), "a STRING, b INT", None, 3) == "NA-3"


def test_role_definition_keeps_dashes_in_title(spark):
    d = one(spark, txt.role_definition("d"), "d STRING", "\n 00100 - Statement - BALANCE - Parent only")
    assert (d.code, d.type, d.title) == ("00100", "Statement", "BALANCE - Parent only")


@pytest.mark.parametrize("html, link", [
    ("<table><tr><td><table><tr><td>x</td></tr></table><a href='/after'>y</a></td></tr></table><a href='/no'>n</a>", "/after"),
    ("<table></table><table><a href='/second'>y</a></table>", None),
    ("<TABLE class='t'><a class='l' HREF=\"/upper\">y</a></TABLE >", "/upper"),
    ("<tablet><a href='/no'>y</a></tablet><table><a href='/open'>", "/open"),
    ("</table><table><a href='/stray'>y</a></table>", "/stray"),
    (None, None), ("", None),
])
def test_first_link_of_nested_and_odd_containers(spark, html, link):
    assert one(spark, txt.first_link("h"), "h STRING", html) == link


def test_first_link_of_first_table(spark):
    html = "<p><a href='/no'>x</a></p><TABLE class=t><tr><td><a id=1 href=\"/ix?doc=/a.htm\">a</a><a href='/b'>b</a></td></tr></TABLE>"
    assert one(spark, txt.first_link("h"), "h STRING", html) == "/ix?doc=/a.htm"
    assert one(spark, txt.first_link("h"), "h STRING", "<p><a href='/no'>x</a></p>") is None


def test_scale_fact(spark):
    df = spark.createDataFrame(
        [("1500", "-2"), ("7", "INF"), ("n/a", "-2"), ("7", None), ("7", "2")], "fact STRING, decimals STRING")
    values = [r.v for r in df.select(num.scale_fact("fact", "decimals").alias("v")).collect()]
    assert values[0] == 15.0 and math.isinf(values[1]) and values[2] is None and values[3] is None and values[4] == 700.0
    kept = df.withColumn("v", num.scale_fact("fact", "decimals")).filter(num.is_finite_or_null("v"))
    assert kept.count() == 4


def test_units_label(spark):
    df = spark.createDataFrame([(d,) for d in ("-6", "0", "2", "INF", None, "-4", "-5", "3", "4", "-12", "10", "-100", "x", "-3")], "d STRING")
    assert [r.u for r in df.select(num.units_label("d").alias("u")).collect()] == [
        f"{u}'s" for u in ("1e+06", "1", "0.01", "0", "NA", "10000", "1e+05", "0.001", "1e-04", "1e+12", "1e-10", "1e+100", "NA", "1000")]


def test_period_key_of_first_quarter_is_last_year(spark):
    days = [(dt.date(2019, 2, 27), "10-K"), (dt.date(2019, 5, 31), "10-Q"), (dt.date(2019, 3, 1), "10-K/A")]
    df = spark.createDataFrame(days, "d DATE, t STRING")
    assert [r.p for r in df.select(per.amended_period_key("d", "t").alias("p")).collect()] == [
        "Q42018", "Q12019", "Q42018A"]


def test_months_and_period_label(spark):
    df = spark.createDataFrame(
        [(dt.date(2019, 1, 1), dt.date(2019, 3, 31)), (dt.date(2019, 1, 1), dt.date(2019, 12, 31)), (None, dt.date(2019, 12, 31))],
        "s DATE, e DATE")
    assert [r.p for r in df.select(per.period_label("s", "e").alias("p")).collect()] == [
        "3 months ended 2019-03-31", "12 months ended 2019-12-31", "NA months ended 2019-12-31"]


def test_months_of_all_spans_of_two_years(spark):
    """Every pair of days against counting on the calendar, with the last day of a short month closing a month."""
    days = spark.range(731).selectExpr("date_add(DATE '2019-01-01', CAST(id AS INT)) AS s")
    pairs = days.join(days.withColumnRenamed("s", "e"), F.col("e") >= F.col("s"))
    counted = F.size(F.filter(F.sequence(F.lit(0), F.lit(24)), lambda n: F.add_months("s", n) <= F.col("e")))
    assert pairs.filter(per.months_covered("s", "e") != counted).isEmpty() and pairs.count() == 731 * 366
    ends = [(dt.date(2019, 1, 30), dt.date(2019, 2, 28), 2), (dt.date(2019, 1, 31), dt.date(2019, 4, 30), 4), (dt.date(2020, 2, 29), dt.date(2021, 2, 28), 13),
            (dt.date(2019, 3, 31), dt.date(2019, 4, 29), 1), (dt.date(2019, 2, 28), dt.date(2019, 3, 27), 1)]
    df = spark.createDataFrame(ends, "s DATE, e DATE, n INT")
    assert df.filter(per.months_covered("s", "e") != F.col("n")).isEmpty()


@pytest.mark.parametrize("html, link", [
    ("<!-- <table><a href='/old'></a></table> --><table><a href='/new?a=1&amp;b=2'></a></table>", "/new?a=1&b=2"),
    ("<script>'<table><a href=/s>'</script><TABLE><a class=x href=/plain>x</a></table>", "/plain"),
    ("<table><a title='a > b' href='/x&#38;&#x2F;&copy;&lt;'>x</a></table>", "/x&/&copy;<"),
    ("<table><a href='/a&b=<c>&#0;&#xD800;'>x</a></table>", "/a&b=<c>"),
    ("<table><!-- <a href='/no'> --><a data-href='/no' href='/yes'>", "/yes"),
    ("<table>x</table><!-- <table><a href='/late'>", None),
])
def test_first_link_is_aware_of_html(spark, html, link):
    assert one(spark, txt.first_link("h"), "h STRING", html) == link
