"""Choosing the roles (sections) of a filing that make up a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallytree.functions.text import has, has_any, lacks_all
from tallytree.operators.firsts import first_per

# The words that mark a statement, in the spellings that count.
BALANCE_WORDS = ["BALANCE", "Balance", "balance"]
INCOME_WORDS = [
    "OPERATIONS", "INCOME", "EARNINGS",
    "Operations", "Income", "Earnings",
    "operations", "income", "earnings",
]
CASH_WORDS = ["CASH", "Cash", "cash"]
PARENTHETICAL_WORD = "Parenth"
COMPREHENSIVE_WORDS = ["Comprehensive", "COMPREHENSIVE"]
DETAILS_WORD = "Details"


def select_roles(
    role: DataFrame, words: list[str], exclude: list[str], type_name: str = "Statement"
) -> DataFrame:
    """Roles of a type whose description has one of the words and none of the excluded ones."""
    return role.filter(
        (F.col("type") == type_name)
        & has_any("description", words)
        & lacks_all("description", exclude)
    )


def balance_roles(role: DataFrame) -> DataFrame:
    return select_roles(role, BALANCE_WORDS, [PARENTHETICAL_WORD])


def cash_flow_roles(role: DataFrame) -> DataFrame:
    return select_roles(role, CASH_WORDS, [PARENTHETICAL_WORD])


def income_roles_strict(role: DataFrame) -> DataFrame:
    return select_roles(role, INCOME_WORDS, [PARENTHETICAL_WORD, *COMPREHENSIVE_WORDS])


def income_roles(role: DataFrame) -> DataFrame:
    """Income roles without the comprehensive ones, unless a filing has only those.

    Both choices are one tier column; the best tier of a filing is a partial aggregate.
    """
    candidates = select_roles(role, INCOME_WORDS, [PARENTHETICAL_WORD]).withColumn(
        "_tier", F.when(lacks_all("description", COMPREHENSIVE_WORDS), 0).otherwise(1)
    )
    best = candidates.groupBy("filing_id").agg(F.min("_tier").alias("_tier"))
    return candidates.join(best, ["filing_id", "_tier"], "left_semi").select(*role.columns)


def details_roles(role: DataFrame) -> DataFrame:
    """Disclosure roles that hold a table of details."""
    return role.filter((F.col("type") == "Disclosure") & has("description", DETAILS_WORD))


def first_role(role: DataFrame) -> DataFrame:
    """The first role of every filing, in document order."""
    return first_per(role, ["filing_id"], ["role_seq", "role_id"])


def distinct_choices(df: DataFrame, column: str) -> DataFrame:
    """The distinct values that would feed a picker."""
    return df.select(column).distinct()


def as_units(role: DataFrame, unit: str | None = None) -> DataFrame:
    """(filing_id, role_id, unit): which roles are read together as one report.

    With ``unit`` all roles of a filing form one report of that name; without it every role
    is a report of its own.
    """
    name = F.lit(unit) if unit else F.col("role_id")
    return role.select("filing_id", "role_id", name.alias("unit")).distinct()


#: So many role ids at most are looked for while arcs are read.
MOST_ROLE_IDS = 1000


def arcs_in_units(arcs: DataFrame, units: DataFrame) -> DataFrame:
    """Arcs of the chosen roles with their unit. ``units`` holds one row per role and unit.

    Filings that use the same role ids let arcs of other roles go before the join shuffles them; where the chosen roles have
    more ids than the driver should see, the join alone sorts them out.
    """
    found = [r.role_id for r in units.select("role_id").distinct().limit(MOST_ROLE_IDS + 1).collect()]
    if len(found) <= MOST_ROLE_IDS:
        arcs = arcs.filter(F.col("role_id").isin([x for x in found if x is not None]))
    return arcs.join(units, ["filing_id", "role_id"])
