"""Labels of report lines and marks for calculated totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallytree.functions.text import has, mark_total
from tallytree.operators.firsts import first_per, leading_ties
from tallytree.operators.roles import arcs_in_units
from tallytree.operators.tree import UNIT
from tallytree.session import pin

# Fixed values of the label linkbase.
STANDARD_LABEL_ROLE = "http://www.xbrl.org/2003/role/label"
LANGUAGE = "en-US"
TITLE_WORD = "Text"


def _preferred(lines: DataFrame, arcs: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Arcs that end in a line, with the label role that they prefer."""
    wanted = lines.select(*keys, "element_id").distinct()
    ends = arcs.select(*on, F.col("to_element_id").alias("element_id"), F.col("preferred_label").alias("label_role"), "arc_seq")
    return ends.join(wanted, [*on, "element_id"]).select(*keys, "element_id", "label_role", "arc_seq")


def _labels_by_role(arcs: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of an arc's element and preferred role; a missing role matches a missing role."""
    a, b = arcs.alias("a"), label.alias("b")
    match = (
        (F.col("a.filing_id") == F.col("b.filing_id"))
        & (F.col("a.element_id") == F.col("b.element_id"))
        & F.col("a.label_role").eqNullSafe(F.col("b.label_role"))
    )
    return a.join(b, match).filter(F.col("b.lang") == LANGUAGE).select(
        *[F.col(f"a.{k}") for k in keys], "a.element_id", "b.label_string",
        "a.arc_seq", "b.label_seq",
    )


def preferred_in_unit(
    lines: DataFrame, presentation: DataFrame, units: DataFrame, label: DataFrame,
    keys: list[str] = UNIT,
) -> DataFrame:
    """First choice: the preferred label stated by an arc of the report; one row per arc and label."""
    arcs = _preferred(lines, arcs_in_units(presentation, units), keys, keys)
    return _labels_by_role(arcs, label, keys)


def preferred_anywhere(
    lines: DataFrame, presentation: DataFrame, units: DataFrame, label: DataFrame,
    keys: list[str] = UNIT,
) -> DataFrame:
    """Second choice: a preferred label stated by an arc of any role of the filing, whether or not a report reads it."""
    arcs = _preferred(lines, presentation.filter("preferred_label IS NOT NULL"), ["filing_id"], keys)
    return _labels_by_role(arcs, label, keys)


def any_label(lines: DataFrame, label: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Third choice: the first label of the element, whatever its role or language."""
    wanted = lines.select(*keys, "element_id").distinct()
    named = label.join(wanted, ["filing_id", "element_id"])
    return first_per(named, [*keys, "element_id"], ["label_seq"]).select(
        *keys, "element_id", "label_string", "label_seq"
    )


#: Stands for a missing place, which comes before all others, where the least of several places is looked for.
_NO_PLACE = -(2**63)


def _least(place: Column | str) -> Column:
    """The least place of a group, NULL if one is missing. A number aggregates by hash, a struct only by sorting all rows."""
    return F.min(F.coalesce(place, F.lit(_NO_PLACE)))


def _place(least: str) -> Column:
    return F.nullif(F.col(least), F.lit(_NO_PLACE))


def _stated(arcs: DataFrame, keys: list[str], tier: int, out: str) -> DataFrame:
    """The label roles that arcs prefer for an element, each with its first arc: an array of as many entries as it has label roles."""
    roles = arcs.groupBy(
        *keys, F.col("to_element_id").alias("element_id"), F.col("preferred_label").alias("label_role")
    ).agg(_least(F.col("arc_seq")).alias("_least"))
    entry = F.struct("label_role", F.struct(F.lit(tier).alias("tier"), _place("_least").alias("arc_seq")).alias("admits"))
    return roles.groupBy(*keys, "element_id").agg(F.collect_list(entry).alias(out))


def ranked_labels(
    lines: DataFrame, presentation: DataFrame, units: DataFrame, label: DataFrame, keys: list[str] = UNIT
) -> DataFrame:
    """Labels of the lines with the choice (1, 2 or 3) that admits them.

    One pass over the labels. Arcs shrink to the label roles of an element before they meet the lines, and these meet the
    labels by filing and element, so labels are dealt out once, and what follows finds the labels of a line together.
    What the arcs say is written in between: the arcs of all roles and all labels are the two largest tables here, and are
    not on disk as shuffles at the same time.
    """
    own = _stated(arcs_in_units(presentation, units), keys, 1, "_own")
    others = _stated(presentation.filter("preferred_label IS NOT NULL"), ["filing_id"], 2, "_others")
    wanted = pin(
        lines.select(*keys, "element_id").distinct()
        .join(own, [*keys, "element_id"], "left")
        .join(others, ["filing_id", "element_id"], "left"),
        "label-choices",
    )
    same_role = lambda stated: F.filter(stated, lambda s: s["label_role"].eqNullSafe(F.col("label_role")))
    admits = lambda stated: F.array_min(F.transform(same_role(stated), lambda s: s["admits"]))
    best = F.when(F.col("lang") == LANGUAGE, F.coalesce(admits("_own"), admits("_others")))
    return label.join(wanted, ["filing_id", "element_id"]).withColumn("_best", best).select(
        *keys, "element_id", "label_string", "label_seq",
        F.coalesce("_best.tier", F.lit(3)).alias("tier"), F.col("_best.arc_seq").alias("arc_seq"),
    )


def label_tiers(
    lines: DataFrame, presentation: DataFrame, units: DataFrame, label: DataFrame,
    keys: list[str] = UNIT,
) -> DataFrame:
    """Distinct labels of the best choice that an element has: keys, element_id, label_string, tier."""
    return best_choice(ranked_labels(lines, presentation, units, label, keys), keys)


def best_choice(ranked: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """The same from labels with their choice."""
    # The third choice takes a single label, the other two take all of theirs.
    single = F.when(F.col("tier") == 3, F.coalesce("label_seq", F.lit(_NO_PLACE)))
    texts = ranked.groupBy(*keys, "element_id", "label_string").agg(
        F.min("tier").alias("tier"), F.min(single).alias("_single"))
    return leading_ties(texts, [*keys, "element_id"], ["tier", F.when(F.col("tier") == 3, F.col("_single"))]).select(
        *keys, "element_id", "label_string", "tier"
    )


def first_label(
    lines: DataFrame, presentation: DataFrame, units: DataFrame, label: DataFrame,
    keys: list[str] = UNIT,
) -> DataFrame:
    """One label per element: best choice, then arc order, then label order."""
    return first_choice(ranked_labels(lines, presentation, units, label, keys), keys)


def first_choice(ranked: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """The same from labels with their choice."""
    return first_per(ranked, [*keys, "element_id"], ["tier", "arc_seq", "label_seq"]).select(
        *keys, "element_id", "label_string", "tier"
    )


def label_order(labels: DataFrame, lines: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """Labels with the place of their line; labels without a line drop out."""
    places = lines.select(*keys, "element_id", "section", "el_order").distinct()
    return labels.join(places, [*keys, "element_id"])


def calculation_parents(calculation: DataFrame, units: DataFrame) -> DataFrame:
    """Elements that the report adds up from others, with the kind of the arc."""
    return (
        arcs_in_units(calculation, units)
        .select("filing_id", "unit", F.col("from_element_id").alias("element_id"), "arcrole")
        .distinct()
    )


def total_label(label: Column | str, arcrole: Column | str, by_word: bool = False) -> Column:
    """Upper-cased label of a calculated total; with ``by_word`` also of labels that say ``Total``."""
    arc = F.col(arcrole) if isinstance(arcrole, str) else arcrole
    is_total = arc.isNotNull()
    if by_word:
        is_total = is_total | has(label, "Total")
    return mark_total(label, is_total)


def disclosure_titles(
    presentation: DataFrame, units: DataFrame, label: DataFrame
) -> DataFrame:
    """Title of every disclosure report: (filing_id, unit, header_element_id, title).

    The header is the parent of the report's first arc. Its title is the label of the first
    arc of the filing from that parent to an element that contains ``Text``, or else its id.
    """
    own = arcs_in_units(presentation, units)
    header = first_per(own, ["filing_id", "unit"], ["arc_seq"]).select(
        "filing_id", "unit", F.col("from_element_id").alias("header_element_id")
    )
    text_arcs = first_per(
        presentation.filter(has("to_element_id", TITLE_WORD)), ["filing_id", "from_element_id"], ["arc_seq"]
    ).select(
        "filing_id", F.col("from_element_id").alias("header_element_id"),
        F.col("to_element_id").alias("element_id"), F.col("preferred_label").alias("label_role"),
        "arc_seq",
    )
    texts = first_per(
        _labels_by_role(text_arcs, label, ["filing_id", "header_element_id"]),
        ["filing_id", "header_element_id"], ["label_seq"],
    ).select("filing_id", "header_element_id", "label_string")
    return header.join(texts, ["filing_id", "header_element_id"], "left").select(
        "filing_id", "unit", "header_element_id",
        F.coalesce("label_string", "header_element_id").alias("title"),
    )
