from pyspark.sql import functions as F

from tallytree import session
from tallytree.operators import ordering, tree

from conftest import rows

SCHEMA = "filing_id BIGINT, unit STRING, arc_seq BIGINT, from_element_id STRING, to_element_id STRING, arc_order STRING"


def arcs(spark, edges, filing=1):
    data = [(filing, "u", i, a, b, o) for i, (a, b, o) in enumerate(edges, start=1)]
    return spark.createDataFrame(data, SCHEMA)


def lines(df):
    return [(r.element_id, r.level2) for r in df.orderBy("filing_id", "el_order").collect()]


def test_numeric_and_text_order_differ(spark):
    edges = [("R", "b", "10"), ("R", "a", "2"), ("R", "c", None)]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, edges)))] == ["a", "b", "c"]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, edges), order_mode="text"))] == ["b", "a", "c"]


def test_uneven_depth_and_shared_child(spark):
    edges = [("R", "A", "1"), ("R", "B", "2"), ("A", "x", "1"), ("B", "x", "1"), ("R", "y", "3"), ("x", "z", "1")]
    out = tree.tree_lines(arcs(spark, edges))
    assert lines(out) == [("z", "A"), ("z", "B"), ("y", "y")]
    assert [r.path for r in out.orderBy("el_order").collect()][0] == ["R", "A", "x", "z"]


def test_two_roots_keep_document_order(spark):
    edges = [("S", "s", "1"), ("R", "r", "1")]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, edges)))] == ["s", "r"]


def test_cycle_is_not_followed(spark):
    closing = [("R", "A", "1"), ("A", "B", "1"), ("B", "A", "1")]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, closing)))] == ["B"]
    going_on = [*closing, ("B", "C", "2")]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, going_on)))] == ["C"]


def test_depth_has_no_limit(spark):
    chain = [(f"n{i}", f"n{i + 1}", "1") for i in range(66)] + [("n3", "side", "2")]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, chain)))] == ["n66", "side"]


def test_rounds_are_the_logarithm_of_the_depth(spark, monkeypatch):
    names = []
    monkeypatch.setattr(session, "PIN_HOOKS", [lambda df, name: names.append(name)])
    for depth, rounds in ((3, 2), (9, 4), (33, 6), (66, 7)):
        names.clear()
        chain = [(f"n{i}", f"n{i + 1}", "1") for i in range(depth)]
        assert tree.tree_paths(arcs(spark, chain)).count() == 1
        assert names.count("tree-walks") <= rounds


def test_longer_cycles_and_a_loop(spark):
    ring = [("R", "a", "1"), ("a", "b", "1"), ("b", "c", "1"), ("c", "d", "1"), ("d", "e", "1"), ("e", "a", "1")]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, ring)))] == ["e"]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, [*ring, ("c", "x", "0"), ("R", "y", "2")])))] == ["x", "e", "y"]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, [("R", "a", "1"), ("a", "a", "1")])))] == ["a"]
    assert [x for x, _ in lines(tree.tree_lines(arcs(spark, [("R", "a", "1"), ("a", "a", "1"), ("a", "z", "2")])))] == ["z"]


def test_each_arc_may_have_its_own_order(spark):
    edges = [("R", "b", "10"), ("R", "a", "2"), ("R", "c", None)]
    both = arcs(spark, edges).withColumn("mode", F.lit("text")).unionByName(arcs(spark, edges, 2).withColumn("mode", F.lit("numeric")))
    assert [x for x, _ in lines(tree.tree_lines(both, order_mode=F.col("mode")))] == ["b", "a", "c", "a", "b", "c"]


def test_same_element_in_other_filing_is_another_tree(spark):
    both = arcs(spark, [("R", "a", "1")]).union(arcs(spark, [("a", "R", "1")], filing=2))
    assert rows(tree.tree_lines(both), "filing_id", "element_id") == [(1, "a"), (2, "R")]


def test_numbering_spreads_a_large_group(spark):
    """One group over many slices gets the same numbers as a window would give."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.xxhash64("id").alias("v"))
    got = ordering.numbered(df, ["k"], ["v"], "n")
    want = df.selectExpr("k", "v", "row_number() OVER (PARTITION BY k ORDER BY v) AS n")
    assert got.exceptAll(want).isEmpty() and got.count() == 20000


def test_level_columns(spark):
    out = tree.level_columns(tree.tree_lines(arcs(spark, [("R", "A", "1"), ("A", "x", "1"), ("R", "y", "2")])), 3)
    assert rows(out, "element_id", "level1", "level2", "level3") == [("x", "R", "A", "x"), ("y", "R", "y", None)]
