"""Null-safe text predicates and the text building blocks of the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def has(column: Column | str, word: str) -> Column:
    """Literal, case-sensitive containment; a missing text contains nothing."""
    return F.coalesce(F.contains(_col(column), F.lit(word)), F.lit(False))


def has_any(column: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """True if any of the words occurs. Case variants are listed by the caller on purpose."""
    return reduce(lambda a, b: a | b, [has(column, word) for word in words], F.lit(False))


def lacks(column: Column | str, word: str) -> Column:
    """Complement of :func:`has`, so rows with a missing text are kept."""
    return ~has(column, word)


def lacks_all(column: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [lacks(column, word) for word in words], F.lit(True))


def paste(*parts: Column | str) -> Column:
    """Concatenate, printing a missing part as ``NA``."""
    return F.concat(*[F.coalesce(_col(p).cast("string"), F.lit("NA")) for p in parts])


def drop_literal(column: Column | str, literal: str, by: str = "") -> Column:
    """Replace every occurrence of a fixed text."""
    return F.replace(_col(column), F.lit(literal), F.lit(by))


def underscore_ids(column: Column | str) -> Column:
    """``prefix:Name`` as used in member values becomes ``prefix_Name`` as used in element ids."""
    return drop_literal(column, ":", "_")


def mark_total(label: Column | str, is_total: Column) -> Column:
    """Upper-case the label of a total line."""
    return F.when(is_total, F.upper(_col(label))).otherwise(_col(label))


def anchor(href: Column | str, text: Column | str) -> Column:
    """An HTML link as text."""
    return F.concat(F.lit('<a href="'), _col(href), F.lit('" target="_blank">'), _col(text), F.lit("</a>"))


def role_definition(definition: Column | str) -> Column:
    """Split ``code - Type - Title``; the title keeps any further `` - ``."""
    shape = r"^\s*(\S+) - (\S+) - (.*)$"
    text = _col(definition)
    return F.struct(
        *[F.nullif(F.regexp_extract(text, shape, i), F.lit("")).alias(name)
          for i, name in enumerate(("code", "type", "title"), start=1)]
    )


#: Parts of a page that hold no elements: comments, and the text of elements that is not read as HTML.
NO_ELEMENTS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|noscript|template)\b[^>]*>.*?</\1\s*>"


def first_link(html: Column | str, container: str = "table") -> Column:
    """``href`` of the first link inside the first ``container`` element, NULL if there is none.

    Comments and the text of scripts, styles and text fields hold no elements. What is left is cut at the tags of the
    container and the pieces are taken until the first one is closed, with the containers nested in it. A container that is never
    closed reaches to the end, and so does a comment. Character references in the link are decoded.
    """
    elements = F.regexp_replace(_col(html), NO_ELEMENTS, "")
    pieces = F.split(elements, rf"(?i)(?=</?{container}[\s>])")
    starts = lambda x, tag: F.regexp_like(x, F.lit(rf"(?i)^{tag}{container}[\s>]"))
    step = lambda x: F.when(starts(x, "</"), -1).when(starts(x, "<"), 1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.lit("").alias("inside"))

    def take(seen: Column, x: Column) -> Column:
        depth = F.greatest(seen["depth"] + step(x), F.lit(0))
        inside = ~seen["closed"] & (depth > 0)
        return F.struct(
            depth.alias("depth"), (seen["closed"] | ((seen["depth"] > 0) & (depth == 0))).alias("closed"),
            F.when(inside, F.concat(seen["inside"], x)).otherwise(seen["inside"]).alias("inside"))

    block = F.aggregate(pieces, start, take, lambda seen: seen["inside"])
    link = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    href = F.concat(*(F.regexp_extract(block, link, i) for i in (1, 2, 3)))
    return F.nullif(decoded(href), F.lit(""))


#: Numbers that are no character of a document, which XML would refuse.
_NO_CHARACTER = (
    r"&#(?:0*(?:[0-8]|1[124-9]|2[0-9]|3[01]|5[5-7][0-9]{3}|[2-9][0-9]{5}|1[2-9][0-9]{4})"
    r"|x0*(?:[0-8bcefBCEF]|1[0-9a-fA-F]|[dD][89a-fA-F][0-9a-fA-F]{2}|[fF]{3}[eEfF]));"
)


def decoded(text: Column) -> Column:
    """Character references by number and the five of XML decoded; anything else after an ampersand is text."""
    known = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,5}|#x[0-9a-fA-F]{1,4});)"
    plain = F.regexp_replace(F.replace(text, F.lit("&#X"), F.lit("&#x")), _NO_CHARACTER, "")
    safe = F.replace(F.regexp_replace(plain, known, "&amp;"), F.lit("<"), F.lit("&lt;"))
    parsed = F.xpath_string(F.concat(F.lit("<a>"), safe, F.lit("</a>")), F.lit("/a"))
    return F.when(F.contains(text, F.lit("&")), parsed).otherwise(text)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
