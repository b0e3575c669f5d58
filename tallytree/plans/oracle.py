"""Building blocks of the SQL that checks the queries: the sample star and the report stages.

Plain ANSI-style SQL over the given tables, written on its own and not from the DataFrame code.
"""

from __future__ import annotations

import re

LABEL = "http://www.xbrl.org/2003/role/label"
TOTAL = "http://www.xbrl.org/2003/role/totalLabel"

STAR = f"""
x_sale AS (
  SELECT o_custkey AS filing_id, type_no, group_id, brand_no, p_brand, element_id, quarter_start, flag,
         CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, min(line_no) AS fact_seq,
         concat(CAST(year(quarter_start) AS VARCHAR), 'Q', CAST(quarter(quarter_start) AS VARCHAR), '_', flag) AS context_id
  FROM (
    SELECT o_custkey, type_no, group_id, brand_no, p_brand, l_returnflag AS flag,
           CASE WHEN type_no = 1 AND brand_no = 25 THEN 'us-gaap_OtherCurrentLiabilities'
                WHEN type_no = 6 AND brand_no = 7 THEN 'us-gaap_RevenueFromContractWithCustomerProductAndServiceExtensibleList'
                WHEN type_no = 6 AND brand_no = 9 THEN 'us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax'
                ELSE concat(group_id, '_', p_brand) END AS element_id,
           CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey * 8 + l_linenumber AS line_no
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN (SELECT p_partkey, p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no,
                 CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'STANDARD' THEN 3
                      WHEN 'SMALL' THEN 4 WHEN 'MEDIUM' THEN 5 WHEN 'LARGE' THEN 6 END AS BIGINT) AS type_no,
                 CASE p_type WHEN 'ECONOMY' THEN 'us-gaap_AssetsCurrent' WHEN 'PROMO' THEN 'us-gaap_InventoryNet'
                      WHEN 'STANDARD' THEN 'us-gaap_PropertyPlantAndEquipmentNet'
                      WHEN 'SMALL' THEN 'us-gaap_LiabilitiesCurrent'
                      WHEN 'MEDIUM' THEN 'us-gaap_LongTermDebtNoncurrent'
                      WHEN 'LARGE' THEN 'us-gaap_StockholdersEquity' END AS group_id
          FROM part) p ON l_partkey = p_partkey
  ) b GROUP BY ALL
),
x_leaf AS (SELECT DISTINCT filing_id, type_no, group_id, brand_no, p_brand, element_id FROM x_sale),
x_seg AS (SELECT c_custkey AS filing_id, c_mktsegment AS seg FROM customer),
x_role AS (
  SELECT filing_id, CAST(role_seq AS BIGINT) AS role_seq, role_id, type, description FROM x_seg CROSS JOIN (VALUES
    (1, 'bs', 'Statement', 'CONSOLIDATED BALANCE SHEETS'),
    (2, 'bsp', 'Statement', 'CONSOLIDATED BALANCE SHEETS (Parenthetical)'),
    (3, 'ci', 'Statement', 'Statements of Comprehensive Income'),
    (4, 'cf', 'Statement', 'Statements of Cash Flows'),
    (5, 'd1', 'Disclosure', 'LEASES (Lease cost) (Details)'),
    (6, 'd2', 'Disclosure', 'LEASES (Tables)'),
    (7, 'x', 'Statement', NULL),
    (8, 'is', 'Statement', 'CONSOLIDATED STATEMENTS OF OPERATIONS'),
    (9, 'bs2', 'Statement', 'Balance sheet of the parent')) v(role_seq, role_id, type, description)
  WHERE NOT (role_id = 'is' AND seg = 'BUILDING') AND NOT (role_id = 'bs2' AND seg <> 'FURNITURE')
),
x_arc AS (
  SELECT filing_id, 'bs' AS role_id, group_id AS f, element_id AS t, brand_no AS ord, 10000 + type_no * 100 + brand_no AS arc_seq FROM x_leaf
  UNION ALL SELECT filing_id, 'bs', 'us-gaap_InventoryNet', element_id, 40, 10240 FROM x_leaf WHERE type_no = 4 AND brand_no = 1
  UNION ALL SELECT filing_id, 'bs2', group_id, element_id, brand_no, 90000 + type_no * 100 + brand_no
            FROM x_leaf JOIN x_seg USING (filing_id) WHERE type_no = 6 AND seg = 'FURNITURE'
  UNION ALL SELECT filing_id, 'is', concat('fx_', p_brand), element_id, type_no, 80100 + brand_no * 10 + type_no
            FROM x_leaf JOIN x_seg USING (filing_id) WHERE seg <> 'BUILDING'
  UNION ALL SELECT filing_id, 'ci', concat('fx_', p_brand), element_id, type_no, 30100 + brand_no * 10 + type_no FROM x_leaf
  UNION ALL SELECT filing_id, 'cf', 'us-gaap_StatementOfCashFlowsAbstract', element_id, (type_no - 1) * 25 + brand_no,
            40000 + (type_no - 1) * 25 + brand_no FROM x_leaf
  UNION ALL SELECT filing_id, 'd1', group_id, element_id, brand_no, 50000 + type_no * 100 + brand_no FROM x_leaf
  UNION ALL SELECT DISTINCT filing_id, 'bs', 'us-gaap_StatementOfFinancialPositionAbstract', group_id, type_no, 10000 + type_no FROM x_leaf
  UNION ALL SELECT DISTINCT filing_id, 'bs2', 'us-gaap_StatementOfFinancialPositionAbstract', group_id, type_no, 90000 + type_no
            FROM x_leaf JOIN x_seg USING (filing_id) WHERE type_no = 6 AND seg = 'FURNITURE'
  UNION ALL SELECT DISTINCT filing_id, 'd1', 'fx_LeasesAbstract', group_id, type_no, 50000 + type_no FROM x_leaf
  UNION ALL SELECT DISTINCT filing_id, 'is', 'us-gaap_IncomeStatementAbstract', concat('fx_', p_brand), brand_no, 80000 + brand_no
            FROM x_leaf JOIN x_seg USING (filing_id) WHERE seg <> 'BUILDING'
  UNION ALL SELECT DISTINCT filing_id, 'ci', 'us-gaap_IncomeStatementAbstract', concat('fx_', p_brand), brand_no, 30000 + brand_no FROM x_leaf
  UNION ALL SELECT filing_id, 'bs', 'us-gaap_StatementOfFinancialPositionAbstract', 'fx_Cash', 9, 10009 FROM x_seg
  UNION ALL SELECT filing_id, 'd1', 'fx_LeasesAbstract', 'fx_LeaseCostTextBlock', 0, 50000 FROM x_seg
),
x_pres AS (
  SELECT filing_id, CAST(arc_seq AS BIGINT) AS arc_seq, role_id, f AS from_element_id, t AS to_element_id,
         CAST(ord AS VARCHAR) AS arc_order,
         CASE WHEN ord % 3 = 0 THEN '{TOTAL}' WHEN ord % 3 = 1 THEN '{LABEL}' END AS preferred_label
  FROM x_arc
),
x_calc AS (
  SELECT filing_id, role_id, concat(group_id, '_Brand#1') AS from_element_id, element_id AS to_element_id,
         CAST(brand_no AS VARCHAR) AS arc_order, 'summation-item' AS arcrole
  FROM x_leaf CROSS JOIN (VALUES ('bs'), ('ci'), ('is'), ('cf'), ('d1')) v(role_id) WHERE brand_no <> 1
),
x_elem AS (
  SELECT filing_id, element_id, CASE WHEN brand_no = 13 THEN NULL WHEN type_no <= 3 THEN 'debit' ELSE 'credit' END AS balance FROM x_leaf
),
x_name AS (
  SELECT filing_id, element_id, brand_no,
         CASE WHEN brand_no = 21 THEN replace(nm, '#21', '#20') ELSE nm END AS nm
  FROM (SELECT *, replace(replace(element_id, 'us-gaap_', ''), '_', ' ') AS nm FROM x_leaf WHERE brand_no <> 24) q
),
x_label AS (
  SELECT filing_id, CAST(1 AS BIGINT) AS label_seq, element_id, '{LABEL}' AS label_role, 'fr' AS lang, concat('fr ', nm) AS label_string FROM x_name
  UNION ALL SELECT filing_id, 2, element_id, '{LABEL}', 'en-US', nm FROM x_name
  UNION ALL SELECT filing_id, 3, element_id, '{TOTAL}', 'en-US', concat('Total ', nm) FROM x_name WHERE brand_no % 2 = 1
  UNION ALL SELECT filing_id, 1, 'fx_LeaseCostTextBlock', '{TOTAL}', 'en-US', 'Lease cost, total' FROM x_seg WHERE seg <> 'HOUSEHOLD'
  UNION ALL SELECT filing_id, 1, 'fx_OilMember', '{LABEL}', 'en-US', 'Oil [Member]' FROM x_seg
),
x_fact AS (
  SELECT filing_id, fact_seq, element_id, context_id,
         CASE WHEN brand_no = 8 THEN 'n/a' WHEN brand_no % 5 = 2 THEN CAST(n AS VARCHAR) ELSE CAST(cents AS VARCHAR) END AS fact,
         CASE WHEN brand_no % 5 = 0 THEN 'INF' WHEN brand_no % 5 = 1 THEN NULL
              WHEN brand_no % 5 = 3 AND flag = 'R' THEN '-3' ELSE '-2' END AS decimals
  FROM x_sale
),
x_ctx AS (
  SELECT DISTINCT filing_id, context_id, CASE WHEN flag <> 'R' THEN quarter_start END AS start_date,
         CAST(last_day(CAST(quarter_start + INTERVAL 2 MONTH AS DATE)) AS DATE) AS end_date,
         CASE WHEN flag = 'A' THEN CASE quarter(quarter_start) WHEN 1 THEN 'BalanceAxis' WHEN 2 THEN 'ScenarioAxis'
              WHEN 3 THEN 'RegionAxis' ELSE 'ProductAxis' END END AS dimension1,
         CASE WHEN flag = 'A' THEN CASE quarter(quarter_start) WHEN 1 THEN 'fx:OtherCurrentLMember' WHEN 2 THEN 'fx:PredecessorMember'
              WHEN 3 THEN 'fx:WestMember' ELSE 'fx:OilMember' END END AS value1,
         CASE WHEN flag = 'A' AND year(quarter_start) % 2 = 0 THEN 'LegalEntityAxis' END AS dimension2
  FROM x_sale
),
x_filing AS (
  SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS filing_date,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10-K' WHEN '2' THEN '10-Q/A' WHEN '5' THEN '8-K' ELSE '10-Q' END AS type,
         concat('/filing/', CAST(o_orderkey AS VARCHAR)) AS href
  FROM orders
),
x_price AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS opening, max(value) AS high,
         min(value) AS low, arg_max(value, event_id) AS closing
  FROM events GROUP BY event_type, CAST(ts AS DATE)
)"""

BALANCE = "(contains(description, 'BALANCE') OR contains(description, 'Balance') OR contains(description, 'balance'))"
CASH = "(contains(description, 'CASH') OR contains(description, 'Cash') OR contains(description, 'cash'))"
INCOME = "regexp_matches(description, 'OPERATIONS|INCOME|EARNINGS|Operations|Income|Earnings|operations|income|earnings')"
NO_PARENTHESES = "NOT contains(description, 'Parenth')"
NOT_COMPREHENSIVE = "NOT contains(description, 'Comprehensive') AND NOT contains(description, 'COMPREHENSIVE')"

# One row per filing, role and unit for each report.
UNITS = {
    "bs": f"SELECT filing_id, role_id, 'bs' AS unit FROM x_role WHERE type = 'Statement' AND {BALANCE} AND {NO_PARENTHESES}",
    "is": f"""SELECT filing_id, role_id, 'is' AS unit FROM x_role WHERE type = 'Statement' AND {INCOME} AND {NO_PARENTHESES}
      QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY CASE WHEN {NOT_COMPREHENSIVE} THEN 0 ELSE 1 END, role_seq) = 1""",
    "cf": f"""SELECT filing_id, role_id, 'cf' AS unit FROM x_role WHERE type = 'Statement' AND {CASH} AND {NO_PARENTHESES}
      QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY role_seq) = 1""",
    "details": "SELECT filing_id, role_id, role_id AS unit FROM x_role WHERE type = 'Disclosure' AND contains(description, 'Details')",
    "all": "SELECT filing_id, role_id, role_id AS unit FROM x_role",
}


def sql(body: str, *ctes: str) -> str:
    """The star and further named queries in front of ``body``."""
    return "WITH RECURSIVE " + ",\n".join([STAR.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def materialized(text: str) -> str:
    """The same SQL with every named query computed once, whatever the planner would choose."""
    return re.sub(r"(?m)^(\s*\w+) AS \($", r"\1 AS MATERIALIZED (", text)


def tree(unit: str, order: str = "numeric") -> str:
    """units, arcs, walk, paths and lines (leaves numbered in preorder) of a report."""
    o = "CAST(arc_order AS DOUBLE)" if order == "numeric" else "arc_order"
    root = "CAST(-1 AS DOUBLE)" if order == "numeric" else "''"
    return f"""
units AS ({UNITS[unit]}),
arcs AS (SELECT p.*, u.unit, {o} AS o FROM x_pres p JOIN units u USING (filing_id, role_id)),
roots AS (
  SELECT filing_id, unit, from_element_id AS element_id, min(arc_seq) AS s FROM arcs a
  WHERE NOT EXISTS (SELECT 1 FROM arcs b WHERE b.filing_id = a.filing_id AND b.unit = a.unit AND b.to_element_id = a.from_element_id)
  GROUP BY ALL
),
walk AS (
  SELECT filing_id, unit, [element_id] AS path, [{{'o': {root}, 's': s}}] AS pk, element_id AS tip FROM roots
  UNION ALL
  SELECT w.filing_id, w.unit, list_append(w.path, a.to_element_id), list_append(w.pk, {{'o': a.o, 's': a.arc_seq}}), a.to_element_id
  FROM walk w JOIN arcs a ON a.filing_id = w.filing_id AND a.unit = w.unit AND a.from_element_id = w.tip
  WHERE NOT list_contains(w.path, a.to_element_id)
),
paths AS (
  SELECT * FROM walk w WHERE NOT EXISTS (
    SELECT 1 FROM arcs a WHERE a.filing_id = w.filing_id AND a.unit = w.unit AND a.from_element_id = w.tip)
),
lines AS (
  SELECT filing_id, unit, 0 AS section, row_number() OVER (PARTITION BY filing_id, unit ORDER BY pk) AS el_order,
         tip AS element_id, path[2] AS level2, path FROM paths
)"""


# Lines that need no walk: the targets of the cash-flow arcs.
CASH_LEAVES = f"""
units AS ({UNITS['cf']}),
leaf_lines AS (SELECT DISTINCT p.filing_id, u.unit, p.to_element_id AS element_id FROM x_pres p JOIN units u USING (filing_id, role_id))"""

VALUE = "TRY_CAST(fact AS DOUBLE) * pow(10, TRY_CAST(decimals AS DOUBLE))"
PERIOD_LABEL = (
    "concat(coalesce(CAST(date_diff('month', start_date, end_date) + 1 AS VARCHAR), 'NA'), ' months ended ', CAST(end_date AS VARCHAR))"
)


def facts_of_lines(source: str, where: str, element: str, period: str) -> str:
    """Facts of lines with period and (possibly replaced) element."""
    return f"""
joined AS (
  SELECT l.filing_id, l.unit, l.section, l.el_order, l.level2, {element} AS element_id, f.fact_seq, f.context_id, f.fact, f.decimals,
         {period} AS period
  FROM {source} l JOIN x_fact f ON f.filing_id = l.filing_id AND f.element_id = l.element_id
  JOIN x_ctx c ON c.filing_id = f.filing_id AND c.context_id = f.context_id
  WHERE c.end_date IS NOT NULL AND {where}
)"""


def first_values(source: str, out: str = "firsts", by: str = "fact") -> str:
    return f"""
{out} AS (
  SELECT * FROM {source} QUALIFY row_number() OVER (
    PARTITION BY filing_id, unit, element_id, {by} ORDER BY section, el_order, fact_seq, context_id) = 1
)"""


def dominant(source: str, out: str = "kept") -> str:
    return f"""
{out} AS (
  SELECT * EXCLUDE (n_rows, max_rows) FROM (
    SELECT *, max(n_rows) OVER (PARTITION BY filing_id, unit) AS max_rows
    FROM (SELECT *, count(*) OVER (PARTITION BY filing_id, unit, period) AS n_rows FROM {source}) q1) q2
  WHERE n_rows * 2 >= max_rows
)"""


def summed(source: str, out: str = "cells") -> str:
    return f"""
{out} AS (
  SELECT DISTINCT filing_id, unit, section, el_order, level2, element_id, decimals, period,
         coalesce(sum(value) OVER (PARTITION BY filing_id, unit, element_id, period), 0) AS value
  FROM (SELECT *, {VALUE} AS value FROM {source}) q
)"""


def first_rows(source: str, out: str = "lead_rows") -> str:
    return f"""
{out} AS (
  SELECT * REPLACE (replace(element_id, ':', '_') AS element_id) FROM (SELECT * FROM {source} QUALIFY rank() OVER (
    PARTITION BY filing_id, unit, element_id ORDER BY section, el_order, decimals ASC NULLS LAST) = 1) q
)"""


def without_repeats(source: str, cells: str, out: str = "shown") -> str:
    """Drop lines with the same second level and the same values in the last two columns."""
    return f"""
ranked_periods AS (
  SELECT filing_id, unit, CAST(period AS VARCHAR) AS period,
         row_number() OVER (PARTITION BY filing_id, unit ORDER BY CAST(period AS VARCHAR) DESC) AS r
  FROM (SELECT DISTINCT filing_id, unit, period FROM {cells}) q
),
row_keys AS (
  SELECT s.filing_id, s.unit, s.section, s.el_order, s.level2, s.element_id,
         max(CASE WHEN r = 1 THEN value END) AS v1, max(CASE WHEN r = 2 THEN value END) AS v2
  FROM {source} s JOIN ranked_periods p ON p.filing_id = s.filing_id AND p.unit = s.unit AND p.period = CAST(s.period AS VARCHAR)
  GROUP BY ALL
),
kept_rows AS (
  SELECT * FROM row_keys QUALIFY row_number() OVER (
    PARTITION BY filing_id, unit, level2, v1, v2 ORDER BY section, el_order, element_id) = 1
),
{out} AS (SELECT s.* FROM {source} s SEMI JOIN kept_rows k USING (filing_id, unit, section, el_order, element_id))"""


def ranked_labels(lines: str) -> str:
    """Labels of the lines' elements with the choice 1, 2 or 3 that admits them."""
    return f"""
wanted AS (SELECT DISTINCT filing_id, unit, element_id FROM {lines}),
tier12 AS (
  SELECT w.filing_id, w.unit, w.element_id, l.label_string, p.arc_seq, l.label_seq,
         CASE WHEN u.role_id IS NOT NULL THEN 1 ELSE 2 END AS tier
  FROM wanted w JOIN x_pres p ON p.filing_id = w.filing_id AND p.to_element_id = w.element_id
  LEFT JOIN units u ON u.filing_id = w.filing_id AND u.unit = w.unit AND u.role_id = p.role_id
  JOIN x_label l ON l.filing_id = w.filing_id AND l.element_id = w.element_id
    AND l.label_role IS NOT DISTINCT FROM p.preferred_label AND l.lang = 'en-US'
  WHERE u.role_id IS NOT NULL OR p.preferred_label IS NOT NULL
),
tier3 AS (
  SELECT w.filing_id, w.unit, w.element_id, l.label_string, CAST(NULL AS BIGINT) AS arc_seq, l.label_seq, 3 AS tier
  FROM wanted w JOIN x_label l USING (filing_id, element_id)
  QUALIFY row_number() OVER (PARTITION BY w.filing_id, w.unit, w.element_id ORDER BY l.label_seq) = 1
),
all_tiers AS (SELECT * FROM tier12 UNION ALL SELECT * FROM tier3),
tiers AS (
  SELECT DISTINCT filing_id, unit, element_id, label_string, tier FROM (
    SELECT * FROM all_tiers QUALIFY rank() OVER (PARTITION BY filing_id, unit, element_id ORDER BY tier) = 1) q
),
single_label AS (
  SELECT filing_id, unit, element_id, label_string, tier FROM all_tiers QUALIFY row_number() OVER (
    PARTITION BY filing_id, unit, element_id ORDER BY tier, arc_seq, label_seq) = 1
)"""


TOTALS = """
totals AS (SELECT DISTINCT c.filing_id, u.unit, c.from_element_id AS element_id, c.arcrole FROM x_calc c JOIN units u USING (filing_id, role_id))"""

RULES = [
    "contains(parent_id, 'AssetsCurrent')",
    "contains(element_id, 'AssetsCurrent')",
    "contains(parent_id, 'Inventory')",
    "contains(element_id, 'Inventory')",
    "contains(parent_id, 'Property')",
    "contains(element_id, 'Property')",
    "contains(parent_id, 'Assets') AND NOT contains(parent_id, 'AssetsCurrent')",
    "contains(element_id, 'Assets')",
    "element_id = 'us-gaap_Assets'",
    "contains(parent_id, 'LiabilitiesCurrent')",
    "contains(element_id, 'LiabilitiesCurrent')",
    "contains(parent_id, 'DebtNoncurrent')",
    "contains(element_id, 'DebtNoncurrent')",
    "contains(parent_id, 'Liabilities') AND NOT contains(parent_id, 'Equity')",
    "contains(element_id, 'Liabilities') AND NOT contains(element_id, 'Equity')",
    "contains(parent_id, 'Equity')",
    "contains(element_id, 'Equity')",
    "contains(element_id, 'us-gaap_LiabilitiesAnd')",
]
PARENTS = f"""
relations AS (SELECT c.*, u.unit FROM x_calc c JOIN units u USING (filing_id, role_id)),
calc_elements AS (
  SELECT filing_id, unit, from_element_id AS element_id FROM relations UNION SELECT filing_id, unit, to_element_id FROM relations),
parents AS (
  SELECT e.filing_id, e.unit, e.element_id, r.from_element_id AS parent_id, r.arc_order, x.balance, l.label_string
  FROM calc_elements e
  LEFT JOIN x_elem x ON x.filing_id = e.filing_id AND x.element_id = e.element_id
  LEFT JOIN relations r ON r.filing_id = e.filing_id AND r.unit = e.unit AND r.to_element_id = e.element_id
  LEFT JOIN x_label l ON l.filing_id = e.filing_id AND l.element_id = e.element_id
  WHERE l.label_role = '{LABEL}'
)"""
LAYOUT = f"""
parented AS (
  SELECT l.*, p.parent_id FROM lines l LEFT JOIN (SELECT DISTINCT filing_id, unit, element_id, parent_id FROM parents) p
    ON p.filing_id = l.filing_id AND p.unit = l.unit AND p.element_id = l.element_id
),
gate AS (
  SELECT filing_id, unit, count(*) FILTER (WHERE parent_id IS NULL) AS orphans,
         count(*) FILTER (WHERE parent_id IS NULL) < 5 AS lay_out
  FROM parented GROUP BY ALL
),
laid_out AS (
  SELECT filing_id, unit, min(section) AS section, el_order, element_id, level2 FROM (
    SELECT p.filing_id, p.unit, p.el_order, p.element_id, p.level2,
           CASE WHEN NOT lay_out THEN 0 {' '.join(f"WHEN {rule} THEN {n}" for n, rule in enumerate(RULES, start=1))} END AS section
    FROM parented p JOIN gate g USING (filing_id, unit)) q
  WHERE section IS NOT NULL GROUP BY filing_id, unit, el_order, element_id, level2
)"""

BALANCE_DIMENSIONS = (
    "(dimension1 IS NULL OR contains(value1, 'OtherCurrentL') OR contains(value1, 'Predece') OR contains(value1, 'Success'))"
)
INCOME_DIMENSIONS = (
    "((dimension1 IS NULL OR (contains(value1, 'Member') AND contains(dimension1, 'Product'))"
    " OR contains(value1, 'Predece') OR contains(value1, 'Success')) AND dimension2 IS NULL)"
)
BALANCE_ELEMENT = "CASE WHEN contains(value1, 'OtherCurrentL') THEN value1 ELSE l.element_id END"
INCOME_ELEMENT = "CASE WHEN contains(value1, 'Member') THEN value1 ELSE l.element_id END"
DIGITS = "TRY_CAST(decimals AS DOUBLE)"
OVERRIDDEN = """
overridden AS (
  SELECT l.* REPLACE (CASE WHEN c_mktsegment = 'MACHINERY'
    AND l.element_id = 'us-gaap_RevenueFromContractWithCustomerProductAndServiceExtensibleList'
    THEN 'us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax' ELSE l.element_id END AS element_id)
  FROM lines l JOIN customer ON c_custkey = l.filing_id
)"""
PRECISE = f"""
precise AS (
  SELECT * FROM cells QUALIFY count(*) FILTER (WHERE {DIGITS} IS NULL) OVER (PARTITION BY filing_id, unit, element_id) = 0
    AND {DIGITS} = max({DIGITS}) OVER (PARTITION BY filing_id, unit, element_id)
)"""
SINGLE = """
cells AS (
  SELECT filing_id, unit, section, el_order, level2, element_id, decimals, period, value FROM kept
  QUALIFY row_number() OVER (PARTITION BY filing_id, unit, section, el_order, level2, element_id, decimals, period
                             ORDER BY fact_seq, context_id) = 1
)"""

BALANCE_SHEET = sql(
    """
SELECT s.filing_id, CAST(s.section AS INTEGER) AS section, s.el_order, s.element_id,
       CASE WHEN t.arcrole IS NOT NULL THEN upper(n.label_string) ELSE n.label_string END AS label,
       t.arcrole IS NOT NULL AS is_total, CAST(s.period AS VARCHAR) AS period, round(s.value, 4) AS value
FROM shown s JOIN tiers n USING (filing_id, unit, element_id) LEFT JOIN totals t USING (filing_id, unit, element_id)
WHERE NOT (coalesce(contains(s.level2, 'Assets'), false) AND contains(s.element_id, 'CurrentLiab'))""",
    tree("bs", "text"), PARENTS, LAYOUT,
    facts_of_lines("laid_out", BALANCE_DIMENSIONS, BALANCE_ELEMENT, "c.end_date"),
    dominant("joined"), first_values("kept"), summed("firsts"), first_rows("cells"),
    without_repeats("lead_rows", "cells"), ranked_labels("shown"), TOTALS,
)
INCOME_STATEMENT = sql(
    """
SELECT filing_id, el_order, CASE WHEN arcrole IS NOT NULL OR contains(label, 'Total') THEN upper(label) ELSE label END AS label,
       arcrole IS NOT NULL AS is_total, period, round(coalesce(sum(value), 0), 4) AS value
FROM (
  SELECT s.filing_id, replace(n.label_string, '[Member]', '') AS label, t.arcrole, s.period, s.value,
         min(s.el_order) OVER (PARTITION BY s.filing_id, replace(n.label_string, '[Member]', '')) AS el_order
  FROM shown s LEFT JOIN single_label n USING (filing_id, unit, element_id) LEFT JOIN totals t USING (filing_id, unit, element_id)) q
GROUP BY filing_id, el_order, label, arcrole, period""",
    tree("is"), OVERRIDDEN,
    facts_of_lines("overridden", INCOME_DIMENSIONS, INCOME_ELEMENT, PERIOD_LABEL),
    first_values("joined"),
    f"valued AS (SELECT *, {VALUE} AS value FROM firsts)", dominant("valued", "frequent"),
    "finite AS (SELECT * FROM frequent WHERE value IS NULL OR NOT isinf(value))",
    first_values("finite", "kept", by="value"), SINGLE, PRECISE, first_rows("precise"),
    without_repeats("lead_rows", "cells"), ranked_labels("shown"), TOTALS,
)
CASH_FLOW = sql(
    """
SELECT s.filing_id, s.el_order, s.element_id,
       CASE WHEN t.arcrole IS NOT NULL THEN upper(n.label_string) ELSE n.label_string END AS label,
       t.arcrole IS NOT NULL AS is_total, s.period, round(s.value, 4) AS value
FROM (SELECT * FROM cells QUALIFY rank() OVER (
        PARTITION BY filing_id, unit, element_id ORDER BY section, el_order, decimals ASC NULLS LAST) = 1) s
LEFT JOIN single_label n USING (filing_id, unit, element_id) LEFT JOIN totals t USING (filing_id, unit, element_id)""",
    tree("cf"), facts_of_lines("lines", "dimension1 IS NULL", "l.element_id", PERIOD_LABEL),
    first_values("joined"), f"valued AS (SELECT *, {VALUE} AS value FROM firsts)", dominant("valued"),
    SINGLE, ranked_labels("cells"), TOTALS,
)
UNITS_TEXT = (
    "concat(CASE WHEN TRY_CAST(decimals AS DOUBLE) IS NULL THEN 'NA' WHEN isinf(TRY_CAST(decimals AS DOUBLE)) THEN '0' "
    "WHEN CAST(decimals AS INT) BETWEEN -4 AND 0 THEN CAST(CAST(pow(10, -CAST(decimals AS INT)) AS BIGINT) AS VARCHAR) "
    "WHEN CAST(decimals AS INT) BETWEEN 1 AND 3 THEN printf('%.*f', CAST(decimals AS INT), pow(10, -CAST(decimals AS INT))) "
    "ELSE printf('%.0e', pow(10, -CAST(decimals AS INT))) END, '''s')"
)
TITLES = """
headers AS (
  SELECT p.filing_id, u.unit, p.from_element_id AS header_element_id FROM x_pres p JOIN units u USING (filing_id, role_id)
  QUALIFY row_number() OVER (PARTITION BY p.filing_id, u.unit ORDER BY p.arc_seq) = 1
),
text_arcs AS (
  SELECT filing_id, from_element_id, to_element_id, preferred_label FROM x_pres WHERE contains(to_element_id, 'Text')
  QUALIFY row_number() OVER (PARTITION BY filing_id, from_element_id ORDER BY arc_seq) = 1
),
titles AS (
  SELECT h.filing_id, h.unit, h.header_element_id, coalesce(l.label_string, h.header_element_id) AS title
  FROM headers h LEFT JOIN text_arcs a ON a.filing_id = h.filing_id AND a.from_element_id = h.header_element_id
  LEFT JOIN x_label l ON l.filing_id = a.filing_id AND l.element_id = a.to_element_id AND l.lang = 'en-US'
    AND l.label_role IS NOT DISTINCT FROM a.preferred_label
  QUALIFY row_number() OVER (PARTITION BY h.filing_id, h.unit ORDER BY l.label_seq) = 1
)"""
DISCLOSURE = sql(
    f"""
SELECT filing_id, unit AS role_id, title, element_id, label_string AS label, arcrole IS NOT NULL AS is_total, units,
       CAST(period AS VARCHAR) AS period, round(coalesce(sum(value), 0), 4) AS value
FROM (
  SELECT c.*, l.label_string, t.arcrole, {UNITS_TEXT.replace('decimals', 'c.decimals')} AS units, h.title
  FROM cells c JOIN arcs p ON p.filing_id = c.filing_id AND p.unit = c.unit AND p.to_element_id = c.element_id
  JOIN x_label l ON l.filing_id = c.filing_id AND l.element_id = c.element_id AND l.lang = 'en-US'
    AND l.label_role IS NOT DISTINCT FROM p.preferred_label
  LEFT JOIN totals t ON t.filing_id = c.filing_id AND t.unit = c.unit AND t.element_id = c.element_id
  JOIN titles h ON h.filing_id = c.filing_id AND h.unit = c.unit) q
GROUP BY filing_id, unit, title, element_id, label_string, arcrole, units, period""",
    tree("details", "text"), facts_of_lines("lines", "fact IS NOT NULL", "l.element_id", "c.end_date"),
    first_values("joined"), summed("firsts"), TITLES, TOTALS,
)
