"""Walking the presentation tree of every filing at once.

Paths grow by doubling: a round joins walks of some length with themselves, which gives walks of twice that length from
every node, and the paths from the roots with the walks. Only arcs between inner nodes take part; leaves, which most
arcs lead to, join once at the end. The number of rounds is the logarithm of the depth of the deepest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallytree.functions.numbers import to_double
from tallytree.operators.ordering import numbered
from tallytree.session import pin

UNIT = ["filing_id", "unit"]


def sibling_key(order_mode: str | Column) -> Column:
    """Sort key of an arc among its siblings: order (missing last), then document order.

    The order counts as a number or as text; a column of ``numeric`` and ``text`` decides for each arc.
    """
    order = to_double("arc_order")
    if isinstance(order_mode, str):
        if order_mode not in ("numeric", "text"):
            raise ValueError(f"order_mode must be 'numeric' or 'text', not {order_mode!r}")
        order_mode = F.lit(order_mode)
    as_text = order_mode == "text"
    return F.struct(
        order.isNull().alias("missing"), F.when(~as_text, order).alias("number"),
        F.when(as_text, order.cast("string")).alias("text"), F.col("arc_seq").alias("seq"),
    )


def tree_roots(arcs: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Parents that are nobody's child, with the place of their first arc."""
    parents = arcs.groupBy(*keys, F.col("from_element_id").alias("element_id")).agg(
        F.min("arc_seq").alias("arc_seq")
    )
    children = arcs.select(*keys, F.col("to_element_id").alias("element_id"))
    return parents.join(children, [*keys, "element_id"], "left_anti")


def tree_paths(
    arcs: DataFrame,
    keys: list[str] = UNIT,
    order_mode: str | Column = "numeric",
) -> DataFrame:
    """One row per root-to-leaf path: ``path``, ``path_key`` (preorder sort key), ``element_id``.

    An arc back to an element already on the path is not followed; a path whose arcs all lead
    back ends there, so the walk ends with the deepest path, however deep.
    """
    parents = arcs.select(*keys, F.col("from_element_id").alias("to_element_id")).distinct()
    edges = pin(
        arcs.join(parents.withColumn("expands", F.lit(True)), [*keys, "to_element_id"], "left")
        .select(
            *keys, F.col("from_element_id").alias("tip"), "to_element_id",
            sibling_key(order_mode).alias("sibling"),
            F.coalesce("expands", F.lit(False)).alias("expands"),
        ),
        "tree-arcs",
    )
    sources = edges.select(
        *keys, F.col("tip").alias("from_element_id"), "to_element_id", F.col("sibling.seq").alias("arc_seq")
    )
    paths = tree_roots(sources, keys).select(
        *keys,
        F.array("element_id").alias("path"),
        F.array(_root_key()).alias("path_key"),
        F.col("element_id").alias("tip"),
    )
    inner = edges.filter("expands").select(
        *keys, "tip", F.array("to_element_id").alias("nodes"), F.array("sibling").alias("steps"))
    leaves = edges.filter("NOT expands").drop("expands")
    # Paths from a root are shorter than a power of two, walks from any node exactly that long.
    walks, cyclic = inner, False
    while True:
        longer = pin(_twice(walks, keys), "tree-walks")
        # One row: whether any walk goes on and whether any arc leads back.
        flags = longer.agg(F.max("simple").alias("goes_on"), F.max(~F.col("simple")).alias("leads_back")).first()
        cyclic = cyclic or bool(flags["leads_back"])
        # Written at the end as well: the join with the leaves, which are most arcs, then stands alone.
        paths = pin(paths.unionByName(_extended(paths, walks, keys)), "tree-paths")
        if not flags["goes_on"]:
            break
        walks = longer.filter("simple").drop("simple")
    ends = paths.join(leaves, [*keys, "tip"]).select(
        *keys, F.concat("path", F.array("to_element_id")).alias("path"),
        F.concat("path_key", F.array("sibling")).alias("path_key"),
    )
    if cyclic:
        # A path whose other arcs lead back goes on to its leaves, if it has any.
        ends = ends.unionByName(_stuck(paths, inner, keys).join(leaves, [*keys, "tip"], "left_anti").drop("tip"))
    return ends.select(*keys, "path", "path_key", tree_leaf("path").alias("element_id"))


def _root_key() -> Column:
    return F.struct(
        F.lit(True).alias("missing"), F.lit(None).cast("double").alias("number"),
        F.lit(None).cast("string").alias("text"), F.col("arc_seq").alias("seq"),
    )


def _twice(walks: DataFrame, keys: list[str]) -> DataFrame:
    """Walks that go on with another one, ``simple`` if no element occurs twice."""
    after = walks.select(
        *keys, F.col("tip").alias("end"), F.col("nodes").alias("more_nodes"), F.col("steps").alias("more_steps"))
    nodes = F.concat("nodes", "more_nodes")
    return walks.withColumn("end", F.element_at("nodes", -1)).join(after, [*keys, "end"]).select(
        *keys, "tip", nodes.alias("nodes"), F.concat("steps", "more_steps").alias("steps"),
        (F.size(F.array_distinct(F.concat(F.array("tip"), nodes))) == F.size(nodes) + 1).alias("simple"))


def _extended(paths: DataFrame, walks: DataFrame, keys: list[str]) -> DataFrame:
    """Paths that go on with a walk from their tip and meet no element again."""
    return paths.join(walks, [*keys, "tip"]).filter(~F.arrays_overlap("path", "nodes")).select(
        *keys, F.concat("path", "nodes").alias("path"), F.concat("path_key", "steps").alias("path_key"),
        F.element_at("nodes", -1).alias("tip"))


def _stuck(paths: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Paths whose arcs to inner nodes all lead back."""
    back = F.array_contains(F.col("path"), F.col("nodes")[0])
    return paths.join(inner, [*keys, "tip"]).groupBy(*keys, "path", "path_key", "tip").agg(
        F.min(back).alias("all_back")).filter("all_back").drop("all_back")


def tree_leaf(path: str) -> Column:
    """Last element of a path."""
    return F.element_at(path, -1)


def level(path: str, k: int) -> Column:
    """The k-th element of a path, NULL beyond its end."""
    return F.try_element_at(F.col(path), F.lit(k))


def level_columns(paths: DataFrame, depth: int) -> DataFrame:
    """Wide form: ``level1`` .. ``level<depth>``."""
    names = [level("path", k).alias(f"level{k}") for k in range(1, depth + 1)]
    kept = [c for c in paths.columns if c not in ("path", "path_key") and not c.startswith("level")]
    return paths.select(*kept, *names)


def tree_lines(
    arcs: DataFrame, keys: list[str] = UNIT, order_mode: str | Column = "numeric", with_path: bool = True
) -> DataFrame:
    """Leaves in depth-first order: keys, ``section``, ``el_order``, ``element_id``, ``level2``, ``path``.

    ``section`` is 0 until a layout puts the lines into display sections. ``with_path=False`` leaves the path out before the
    lines are sorted; it repeats the element and the second level.
    """
    paths = tree_paths(arcs, keys, order_mode).withColumn("level2", level("path", 2))
    if not with_path:
        paths = paths.drop("path")
    lines = numbered(paths, keys, ["path_key"], "el_order", without=("path_key",))
    return lines.select(*keys, F.lit(0).alias("section"), "el_order", "element_id", "level2", *["path"] * with_path)
