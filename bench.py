"""Benchmark of the headline jobs.

Reads the generated tables at $BENCH_SF_DIR (default /root/testdata/sf0.1),
derives the application tables once and stores them as Parquet in a scratch
folder (sales partitioned by sale month, as the table store writes them),
then times every headline job over the stored tables on local[$BENCH_CPUS].
Each stored table is written as 2 x cpus files (sales: one file per month),
as a real input is split across many files; without that, the load step's
coalesced last stage leaves one file and the jobs read it on a few threads.
Each job is fully executed with a no-op write (nothing is collected). Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from stockbook.operators import catalog, checkout, inventory, ledger, quality  # noqa: E402
from stockbook.operators import receipts as rc  # noqa: E402
from stockbook.operators import sales as sl  # noqa: E402
from stockbook.plans import registry as R  # noqa: E402
from stockbook.session import checkpoint_dir, get_spark  # noqa: E402
from stockbook.sources import testmap as tm  # noqa: E402
from stockbook.sources.schema import PRODUCTS, SALE_ITEMS, SALES  # noqa: E402
from stockbook.sources.tables import read_table  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="stockbook-bench", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": "16g"})
    scratch = tempfile.mkdtemp(prefix="stockbook-bench-")
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        # local benchmark only: a scratch folder when none is configured
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    checkpoint_dir(spark)

    t0 = time.time()
    files = 2 * cpus
    tm.products(spark, sf_dir).repartition(files).write.parquet(f"{scratch}/products")
    (tm.sales(spark, sf_dir).withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
     .repartition("sale_month").write.partitionBy("sale_month").parquet(f"{scratch}/sales"))
    tm.sale_items(spark, sf_dir).repartition(files).write.parquet(f"{scratch}/sale_items")
    tm.stock_events(spark, sf_dir).repartition(files).write.parquet(f"{scratch}/stock_events")
    tm.carts(spark, sf_dir).repartition(files).write.parquet(f"{scratch}/carts")
    tm.product_requests(spark, sf_dir).repartition(files).write.parquet(f"{scratch}/product_requests")
    load_sec = time.time() - t0

    products = read_table(spark, f"{scratch}/products", PRODUCTS)
    sales = read_table(spark, f"{scratch}/sales", SALES)
    items = read_table(spark, f"{scratch}/sale_items", SALE_ITEMS)
    events = spark.read.parquet(f"{scratch}/stock_events")
    carts = spark.read.parquet(f"{scratch}/carts")
    requests = spark.read.parquet(f"{scratch}/product_requests")

    def run_checkout():
        res = checkout.checkout(carts, products, sales, items)
        for df in (res.decisions, res.sales, res.sale_items, res.products):
            df.write.format("noop").mode("overwrite").save()

    jobs = {
        "dashboard_kpis": lambda: sl.dashboard_kpis(products, sales, R.AS_OF),
        "sales_history": lambda: sl.sales_history(sales, items, R.DATE_FROM, R.DATE_TO),
        "sales_analytics": lambda: sl.sales_analytics(sales, R.DATE_FROM, R.DATE_TO),
        "receipts_by_number": lambda: rc.receipts_by_number(sales, items, R.NUMBER_TERM),
        "receipts_by_product": lambda: rc.receipts_by_product(sales, items, products, R.PRODUCT_TERM),
        "receipts_high_value": lambda: rc.receipts_high_value(sales, items, R.HIGH_VALUE),
        "receipts_recent": lambda: rc.receipts_recent(sales, items, 10),
        "inventory_overview": lambda: inventory.inventory_overview(products),
        "inventory_summary": lambda: inventory.inventory_summary(products),
        "new_product_check": lambda: catalog.new_product_check(products, requests),
        "integrity_report": lambda: quality.integrity_report(products, sales, items),
        "stock_ledger": lambda: ledger.stock_ledger(products, events)[1],
        "cart_preview": lambda: checkout.cart_preview(carts, products),
        "checkout": run_checkout,
    }
    times = {}
    for name, job in jobs.items():
        t = time.time()
        out = job()
        if out is not None:
            out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_job_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "load_sec": round(load_sec, 3), "cpus": cpus}))


if __name__ == "__main__":
    main()
