"""Properties of plans and results that must hold at any scale."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tallytree import session
from tallytree.operators import firsts
from tallytree.plans import catalog, reports, sample_star
from tallytree.star import Star

from conftest import rows

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", [
    "dominant_periods", "label_tiers", "label_first", "element_parent", "disclosure_title", "filing_index_topn",
    "company_lookup", "statement_sum", "candles", "cash_flow", "balance_sheet",
])
def test_no_python_no_cross_join_no_single_partition(spark, name):
    plan = plan_of(catalog.CATALOG[name].build(spark, SF_DIR))
    for unwanted in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert unwanted not in plan


def test_first_pick_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = plan_of(firsts.first_per(df, ["k"], ["v"]))
    assert re.search(r"WindowGroupLimit.*[\s\S]*Exchange", plan) and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(catalog.CATALOG["role_details"].build(spark, SF_DIR))
    assert "EqualTo(type,Disclosure)" in plan
    facts = plan_of(sample_star.landed_star(spark, SF_DIR).fact.select("filing_id", "fact"))
    assert re.search(r"ReadSchema: struct<filing_id:bigint,fact:string>", facts)


@pytest.fixture(scope="module")
def star(spark):
    return sample_star.landed_star(spark, SF_DIR)


def _same(a, b):
    return rows(a.withColumn("value", F.round("value", 4))) == rows(b.withColumn("value", F.round("value", 4)))


def test_input_order_and_other_filings_do_not_matter(spark, star):
    """A filing alone, with its rows shuffled, has the same balance sheet as among all others."""
    some = spark.range(0, 10).select(F.col("id").alias("filing_id"))
    alone = star.only(some)
    shuffled = Star(**{
        name: getattr(alone, name).orderBy(F.rand(7)).repartition(5)
        for name in ("role", "presentation", "calculation", "element", "label", "fact", "context")
    })
    among_all = reports.balance_sheet(star).join(some, "filing_id", "left_semi")
    assert _same(reports.balance_sheet(shuffled), among_all)


def test_printed_lines_are_leaves(spark, star):
    lines = reports.cash_flow(star).select("filing_id", "element_id").distinct()
    parents = star.presentation.filter("role_id = 'cf'").select("filing_id", F.col("from_element_id").alias("element_id"))
    assert lines.join(parents, ["filing_id", "element_id"], "left_semi").isEmpty()


def test_sections_follow_display_order(spark, star):
    out = reports.balance_sheet(star)
    assert out.filter("section > 0").count() > 0 and out.filter("section = 0").count() > 0


@pytest.mark.parametrize("name", ["statement_lines", "balance_sheet", "label_tiers", "xml_presentation"])
def test_every_written_step_is_distributed(spark, monkeypatch, name):
    """No step of a query, as far as it is written, multiplies rows in a cross join or brings them into one partition."""
    plans = {}
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: plans.setdefault(f"{step}-{len(plans)}", plan_of(df))])
    plans["result"] = plan_of(catalog.CATALOG[name].build(spark, SF_DIR))
    assert len(plans) > 1 or name == "label_tiers"
    for step, plan in plans.items():
        for unwanted in ("PythonUDF", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert unwanted not in plan, step


def test_statements_share_their_steps(spark, star, monkeypatch):
    """One walk and ten written tables for three statements, and the same rows as each statement alone."""
    steps = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.append(step)])
    together = reports.statement_lines(star)
    assert steps.count("tree-arcs") == 1 and len(steps) <= 10
    alone = {"balance_sheet": reports.balance_sheet(star), "cash_flow": reports.cash_flow(star), "income_statement": reports.income_statement(star)}
    for name, report in alone.items():
        mine = together.filter(F.col("statement") == name).select(*report.columns)
        assert _same(mine, report)
