"""Plan shape checks on stored tables: pushdown, top-k, no Python UDFs."""

import tempfile

from pyspark.sql import functions as F

from stockbook.operators import receipts as rc
from stockbook.operators import sales as sl
from stockbook.plans.checks import plan_text
from stockbook.sources import testmap as tm
from stockbook.sources.schema import SALE_ITEMS, SALES
from stockbook.sources.tables import read_table
from conftest import SF001


def _stored(spark):
    d = tempfile.mkdtemp(prefix="stockbook-plan-")
    (tm.sales(spark, SF001).withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
     .write.partitionBy("sale_month").parquet(f"{d}/sales"))
    tm.sale_items(spark, SF001).write.parquet(f"{d}/sale_items")
    return read_table(spark, f"{d}/sales", SALES), read_table(spark, f"{d}/sale_items", SALE_ITEMS)


def test_history_plan(spark):
    s, i = _stored(spark)
    plan = plan_text(sl.sales_history(s, i, "1997-01-01", "1997-01-31"))
    assert "PushedFilters: [IsNotNull(sale_date), GreaterThanOrEqual(sale_date" in plan
    assert "PartitionFilters: [isnotnull(sale_month" in plan      # month folders pruned
    assert "TakeOrderedAndProject" in plan or "TopK" in plan or "Limit" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # only the needed columns of sale_items are read
    assert "ReadSchema: struct<id:bigint,sale_id:bigint>" in plan


def test_receipt_search_plan(spark):
    s, i = _stored(spark)
    plan = plan_text(rc.receipts_by_number(s, i, "19970115"))
    assert "BatchEvalPython" not in plan
    assert "HashAggregate" in plan
