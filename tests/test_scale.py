"""What a query makes, shuffles and broadcasts grows with what it reads."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from tallytree import session
from tallytree.operators import labels, reshape, roles, tree
from tallytree.plans import sample_documents, sample_star
from tallytree.sources import instance, pieces, rejects
from tallytree.star import SCHEMAS

from conftest import rows
from test_sources import CAL, INSTANCE, LAB, PRE, XSD, write

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@needs_data
def test_only_the_tables_asked_for_are_made(spark):
    star = sample_star.SampleStar(spark, SF_DIR)
    assert star.role.count() > 0 and len(star.landed) == 1
    assert star.calculation.count() > 0 and "_facts" not in star.__dict__ and len(star.landed) == 2
    path = sample_star.landed_star_path(spark, SF_DIR, "fact")
    assert session.path_exists(spark, f"{path}/fact") and not session.path_exists(spark, f"{path}/presentation")


def test_arcs_of_other_roles_are_not_made(spark):
    """Own rows: a filter on the role leaves out the branches of the others, and all roles together lose nothing."""
    leaves = spark.createDataFrame(
        [(1, 4, "Brand#1", "FURNITURE", 1, True, True), (1, 6, "Brand#12", "FURNITURE", 1, True, True), (2, None, None, None, 1, True, True)],
        "filing_id BIGINT, type_no BIGINT, p_brand STRING, c_mktsegment STRING, nth INT, leads_group BOOLEAN, leads_brand BOOLEAN")
    customer = spark.createDataFrame([(1, "FURNITURE"), (None, None)], "c_custkey BIGINT, c_mktsegment STRING")
    arcs = sample_star.presentation(leaves, customer)
    plan = arcs.filter(F.col("role_id") == "cf")._jdf.queryExecution().optimizedPlan().toString()
    live = "".join(b for b in re.split(r"\n(?=[:+]- )", plan) if "LocalRelation <empty>" not in b)
    assert sample_star.CASH_ROOT in live and sample_star.INCOME_ROOT not in live and sample_star.LEASE_TEXT not in live
    counts = {r.role_id: r["count"] for r in arcs.filter("filing_id = 1").groupBy("role_id").count().collect()}
    assert counts == {"bs": 6, "bs2": 2, "is": 4, "ci": 4, "cf": 2, "d1": 5}


def test_arcs_of_other_roles_go_before_the_join(spark, monkeypatch):
    arcs = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "b", "z"), (2, None, "n")], "filing_id BIGINT, role_id STRING, to_element_id STRING")
    units = spark.createDataFrame([(1, "a", "bs"), (2, "b", "bs"), (2, None, "bs")], "filing_id BIGINT, role_id STRING, unit STRING")
    few = roles.arcs_in_units(arcs, units.filter("role_id = 'a'"))
    assert "role_id#" in few._jdf.queryExecution().optimizedPlan().toString() and [r.to_element_id for r in few.collect()] == ["x"]
    found = rows(roles.arcs_in_units(arcs, units))
    monkeypatch.setattr(roles, "MOST_ROLE_IDS", 0)
    assert found == rows(roles.arcs_in_units(arcs, units)) and len(found) == 2


def test_locators_are_never_broadcast(spark, tmp_path):
    """Links of a few bytes may hold any number of locators."""
    write(str(tmp_path / "7"), w_ins_xml=INSTANCE, w_cal_xml=CAL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        arcs = instance.read_calculation(spark, str(tmp_path))
        plan = arcs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan and arcs.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_of_reports_know_the_size_of_rows(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    session.join_by_row_size(spark, False)
    before = spark.conf.get(key)
    spark.conf.set(key, "2MB")
    try:
        session.join_by_row_size(session.join_by_row_size(spark))
        assert spark.conf.get(key) == session.JOIN_SETTINGS[key] == "256KB"
        session.join_by_row_size(spark, False)
        assert spark.conf.get(key) == "2MB"
    finally:
        spark.conf.set(key, before)


def _shuffle_files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")]


def test_shuffles_go_when_a_job_has_ended(spark, tmp_path):
    """A session of its own settings: pins leave no shuffle behind, and what is asked for twice is still whole."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    session.clean_after_jobs(spark, False)
    before = spark.conf.get(session.CLEAN_KEY, None)
    session.clean_after_jobs(session.clean_after_jobs(spark))
    try:
        known = {f for folder in local for f in _shuffle_files(folder)}
        counts = spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count()
        pinned = session.pin(counts, "counted")
        for _ in range(50):
            left = {f for folder in local for f in _shuffle_files(folder)} - known
            if not left:
                break
            time.sleep(0.1)
        assert not left and pinned.count() == 97
        assert rows(counts) == rows(counts) and counts.collect() == counts.collect()
    finally:
        session.clean_after_jobs(spark, False)
    assert spark.conf.get(session.CLEAN_KEY, None) == before


@needs_data
def test_sample_documents_are_small_and_in_order(spark):
    """XML lies there compressed, a filing is in one document, and documents follow each other by name."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        path = sample_documents.label_documents(spark, SF_DIR)
    finally:
        spark.conf.unset(key)
    names = [f for _, _, found in os.walk(path.removeprefix("file://")) for f in found if not f.startswith((".", "_"))]
    assert names and all(f.endswith(".xml.gz") for f in names)
    link = spark.read.format("xml").option("rowTag", "loc").option("recursiveFileLookup", "true").schema("_label STRING").load(path)
    filers = link.select(F.regexp_extract("_label", r"_(\d+)_", 1).cast("int").alias("filer"), F.col("_metadata.file_path").alias("f")).groupBy("f").agg(
        F.min("filer").alias("a"), F.max("filer").alias("b"))
    spans = sorted((os.path.dirname(r.f), os.path.basename(r.f), r.a, r.b) for r in filers.collect())
    assert all(x[0] != y[0] or x[3] < y[2] for x, y in zip(spans, spans[1:])) and len(spans) > len({x[0] for x in spans})


def test_arcs_are_resolved_step_by_step(spark, tmp_path, monkeypatch):
    write(str(tmp_path / "7"), w_ins_xml=INSTANCE, w_pre_xml=PRE)
    steps = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.append(step)])
    arcs = instance.read_presentation(spark, str(tmp_path))
    assert steps.index("presentation-links") < steps.index("presentation-from") < steps.index("presentation-to") and arcs.count() > 0
    assert "SortMergeJoin" not in arcs._jdf.queryExecution().executedPlan().toString()


def test_documents_are_told_apart_by_their_tags(spark, tmp_path, monkeypatch):
    """A kind of thing is looked for only in documents that hold its tag, with any prefix; what is found stays the same."""
    root = str(tmp_path / "in")
    write(f"{root}/7", w_ins_xml=INSTANCE, w_pre_xml=PRE, w_cal_xml=CAL, w_lab_xml=LAB, w_xsd=XSD)
    holding = pieces.documents_holding(spark, root, "*.xml", instance.TAGS | {"none": ("nowhere",)})
    names = {kind: [os.path.basename(f) for f in found] for kind, found in holding.items()}
    assert names["presentation"] == ["w_pre.xml"] and names["calculation"] == ["w_cal.xml"] and names["label"] == ["w_lab.xml"]
    assert names["context"] == ["w_ins.xml"] and len(names["none"]) == 1
    read = []
    xml = instance._xml
    monkeypatch.setattr(instance, "_xml", lambda session, where, files, tag, schema: read.append((tag, where)) or xml(session, where, files, tag, schema))
    told = instance.load_filings(spark, root)
    assert read and all(isinstance(where, list) and len(where) == 1 for _, where in read)
    monkeypatch.setattr(pieces, "MOST_DOCUMENTS", 1)
    read.clear()
    every = instance.load_filings(spark, root)
    assert all(where == root for _, where in read)
    for name in SCHEMAS:
        columns = [c for c in getattr(told, name).columns if not c.endswith("_seq")]
        found = rows(getattr(told, name), *columns)
        assert found and found == rows(getattr(every, name), *columns), name


def test_names_that_a_path_can_not_state_are_read_as_before(spark, tmp_path):
    root = str(tmp_path / "in")
    write(f"{root}/7", **{"w_ins_xml": INSTANCE})
    os.rename(f"{root}/7/w_ins.xml", f"{root}/7/w [1].xml")
    assert set(pieces.documents_holding(spark, root, "*.xml", instance.TAGS).values()) == {root}
    assert instance.load_filings(spark, root).context.count() > 0


def test_rejects_are_written_one_after_the_other(spark, tmp_path, monkeypatch):
    write(str(tmp_path / "7"), w_ins_xml=INSTANCE, w_pre_xml=PRE)
    steps = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.append(step)])
    found = rejects.rejects(spark, str(tmp_path))
    assert steps.count("found-rejects") == 11 and "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_are_sorted_without_their_paths(spark, monkeypatch):
    """What serves the order only, and paths that nobody asks for, are not written."""
    arcs = spark.createDataFrame(
        [(1, "u", "r", "b", "2", 1), (1, "u", "r", "c", "1", 2), (1, "u", "b", "d", "1", 3)],
        "filing_id INT, unit STRING, from_element_id STRING, to_element_id STRING, arc_order STRING, arc_seq BIGINT")
    written = {}
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: written.setdefault(step, []).append(df.columns)])
    short, full = tree.tree_lines(arcs, with_path=False), tree.tree_lines(arcs)
    assert [set(c) & {"path", "path_key"} for c in written["numbered"]] == [set(), {"path"}]
    assert full.columns == [*short.columns, "path"] and rows(short) == rows(full, *short.columns)
    assert rows(full, "el_order", "element_id", "level2", "path") == [(1, "c", "c", ["r", "c"]), (2, "d", "b", ["r", "b", "d"])]


def test_documents_are_read_once_for_broken_ones(spark, tmp_path, monkeypatch):
    """A broken document is found whichever tag is asked for, so one pattern of names is one read."""
    write(str(tmp_path / "7"), w_ins_xml=INSTANCE, broken_xml='<link:linkbase><link:label xlink:role=r>C</link:label></link:linkbase>')
    for tag in rejects.ROW_TAGS.values():
        assert rejects.broken_documents(spark, str(tmp_path), "*.xml", tag).count() == 1
    steps = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.append(step)])
    parts = {part: "*.xml" for part in rejects.ROW_TAGS}
    assert rejects.rejects(spark, str(tmp_path), parts).filter("kind = 'broken_document'").count() == 1
    assert steps.count("broken-documents") == 1 and steps.count("label-texts") == 1


def test_printed_lines_are_computed_once(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, 1, "A", "2020", 1.0), (1, 0, 2, "B", "2021", 2.0)], "filing_id BIGINT, section INT, el_order BIGINT, label STRING, period STRING, value DOUBLE")
    steps = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.append(step)])
    assert reshape.display_by_rank(lines, "H", columns=2).count() == 3 and steps == ["printed-lines"]
    plan = reshape.display(lines.withColumn("value", F.rand(3)), "H", periods=["2020"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in plan


def _two_reports(spark):
    """Element ``a`` in two reports and in a role that neither reads; some arcs and labels have no place."""
    lines = spark.createDataFrame([(1, "u", "a"), (1, "v", "a"), (1, "u", "b")], "filing_id BIGINT, unit STRING, element_id STRING")
    units = spark.createDataFrame([(1, "u", "r1"), (1, "v", "r2")], "filing_id BIGINT, unit STRING, role_id STRING")
    arcs = spark.createDataFrame([
        (1, 1, "r1", "x", "a", "1", "plain"), (1, 4, "r1", "x", "a", "1", "terse"), (1, None, "r1", "x", "a", "1", "terse"),
        (1, 2, "r2", "x", "a", "1", None), (1, 3, "r3", "x", "a", "1", "total"), (1, 5, "r3", "x", "b", "1", None),
    ], "filing_id BIGINT, arc_seq BIGINT, role_id STRING, from_element_id STRING, to_element_id STRING, arc_order STRING, preferred_label STRING")
    label = spark.createDataFrame([
        (1, 1, "a", "plain", "en-US", "A"), (1, 2, "a", "terse", "en-US", "A short"), (1, 3, "a", "total", "en-US", "A total"),
        (1, 4, "b", "plain", "en-US", "B"), (1, None, "b", "plain", "fr", "B fr"),
    ], "filing_id BIGINT, label_seq BIGINT, element_id STRING, label_role STRING, lang STRING, label_string STRING")
    return lines, arcs, units, label


def test_arcs_and_labels_are_not_dealt_out_at_once(spark, monkeypatch):
    steps = {}
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, step: steps.setdefault(step, df.columns)])
    found = labels.ranked_labels(*_two_reports(spark))
    assert steps["label-choices"] == ["filing_id", "element_id", "unit", "_own", "_others"]
    assert "preferred_label" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_dealt_out_once(spark):
    """Labels meet the lines by filing and element, arcs shrink by hash: nothing is sorted for a least place."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        lines, arcs, units, label = _two_reports(spark)
        found = labels.ranked_labels(lines, arcs, units, label)
        plan = labels.best_choice(found)._jdf.queryExecution().executedPlan().toString()
        after = plan[:plan.index("SortMergeJoin")]
        assert "SortAggregate" not in plan and "Exchange" not in after
        # The arcs of other roles go before the labels of a report are joined.
        own = labels.preferred_in_unit(lines, arcs, units, label)._jdf.queryExecution().optimizedPlan().toString()
        assert "role_id" in own[own.index("Filter"):] and "LeftOuter" not in own
        assert "LeftOuter" not in labels.preferred_anywhere(lines, arcs, units, label)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_choices_of_labels_in_two_reports(spark):
    star = _two_reports(spark)
    ranked = labels.ranked_labels(*star)
    assert rows(ranked, "unit", "element_id", "label_string", "tier", "arc_seq") == [
        ("u", "a", "A", 1, 1), ("u", "a", "A short", 1, None), ("u", "a", "A total", 2, 3), ("u", "b", "B", 3, None), ("u", "b", "B fr", 3, None),
        ("v", "a", "A", 2, 1), ("v", "a", "A short", 2, None), ("v", "a", "A total", 2, 3)]
    assert rows(labels.best_choice(ranked), "unit", "label_string", "tier") == [
        ("u", "A", 1), ("u", "A short", 1), ("u", "B fr", 3), ("v", "A", 2), ("v", "A short", 2), ("v", "A total", 2)]
    assert rows(labels.first_choice(ranked), "unit", "label_string", "tier") == [("u", "A short", 1), ("u", "B fr", 3), ("v", "A short", 2)]
    assert rows(labels.preferred_in_unit(*star), "unit", "label_string", "arc_seq") == [("u", "A", 1), ("u", "A short", 4), ("u", "A short", None)]
    assert len(rows(labels.preferred_anywhere(*star))) == 8
