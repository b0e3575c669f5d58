"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated choice. Every query runs to a sink that keeps nothing, so the whole
result is computed and none of it is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallytree.plans.catalog import CATALOG
from tallytree.plans.sample_star import landed_star_path
from tallytree.session import build_session

HEADLINE = [
    "balance_sheet", "income_statement", "cash_flow", "disclosure_table",
    "tree_order", "fact_first", "dominant_periods", "label_tiers", "statement_wide",
    "filing_index_topn", "filing_first_period", "filing_document_pick", "first_link", "text_clean", "candles", "xml_facts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("tallytree-bench", **{
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def clock(name, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    # Loading the filings once is work that every report shares.
    clock("land_star", lambda: landed_star_path(spark, sf_dir))
    for name in names:
        build = CATALOG[name].build
        clock(name, lambda: build(spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
