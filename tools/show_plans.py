"""Print a plan summary of every headline job over stored tables.

    python tools/show_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from stockbook.operators import catalog, inventory, quality  # noqa: E402
from stockbook.operators import receipts as rc  # noqa: E402
from stockbook.operators import sales as sl  # noqa: E402
from stockbook.plans import registry as R  # noqa: E402
from stockbook.plans.checks import plan_text  # noqa: E402
from stockbook.session import get_spark  # noqa: E402
from stockbook.sources import testmap as tm  # noqa: E402
from stockbook.sources.schema import PRODUCTS, SALE_ITEMS, SALES  # noqa: E402
from stockbook.sources.tables import read_table  # noqa: E402


def summary(name: str, df) -> str:
    p = plan_text(df, "formatted")
    ops = {k: len(re.findall(rf"^\(\d+\) {k}\b", p, re.M)) for k in
           ("Exchange", "BroadcastExchange", "Window", "HashAggregate", "SortMergeJoin", "BroadcastHashJoin",
            "ShuffledHashJoin", "TakeOrderedAndProject", "Sort", "Generate")}
    blocks = [b for b in p.split("\n\n") if re.match(r"^\(\d+\) Scan parquet", b.strip())]

    def field(block, key):
        m = re.search(rf"^{key}: ([^\n]*)$", block, re.M)
        return m.group(1) if m else "-"
    lines = [f"### {name}", "", "| operator | count |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in ops.items() if v]
    lines += ["", "Scans (columns read / pushed filters / partition filters):", ""]
    for b in blocks:
        b = b.strip()
        lines.append(f"- `{field(b, 'ReadSchema')[:160]}` / `{field(b, 'PushedFilters')[:160]}` / "
                     f"`{field(b, 'PartitionFilters')[:120]}`")
    lines.append("")
    return "\n".join(lines)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    d = tempfile.mkdtemp(prefix="stockbook-plans-")
    tm.products(spark, sf_dir).write.parquet(f"{d}/products")
    (tm.sales(spark, sf_dir).withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
     .repartition("sale_month").write.partitionBy("sale_month").parquet(f"{d}/sales"))
    tm.sale_items(spark, sf_dir).write.parquet(f"{d}/sale_items")
    tm.product_requests(spark, sf_dir).write.parquet(f"{d}/requests")
    p = read_table(spark, f"{d}/products", PRODUCTS)
    s = read_table(spark, f"{d}/sales", SALES)
    i = read_table(spark, f"{d}/sale_items", SALE_ITEMS)
    req = spark.read.parquet(f"{d}/requests")
    jobs = {
        "dashboard_kpis": sl.dashboard_kpis(p, s, R.AS_OF),
        "sales_history": sl.sales_history(s, i, R.DATE_FROM, R.DATE_TO),
        "sales_analytics": sl.sales_analytics(s, R.DATE_FROM, R.DATE_TO),
        "receipts_by_number": rc.receipts_by_number(s, i, R.NUMBER_TERM),
        "receipts_by_product": rc.receipts_by_product(s, i, p, R.PRODUCT_TERM),
        "receipts_high_value": rc.receipts_high_value(s, i, R.HIGH_VALUE),
        "receipts_recent": rc.receipts_recent(s, i, 10),
        "inventory_summary": inventory.inventory_summary(p),
        "new_product_check": catalog.new_product_check(p, req),
        "integrity_report": quality.integrity_report(p, s, i),
    }
    print("# PLANS\n")
    print("Physical plans (AQE initial plans, before runtime re-planning) of the report jobs over stored")
    print(f"tables derived from `{sf_dir}`; produced by `tools/show_plans.py`. The ordered jobs")
    print("(ledger, admission) are multi-job and described in their module docstrings.\n")
    for name, df in jobs.items():
        print(summary(name, df))


if __name__ == "__main__":
    main(sys.argv)
