"""Month folders walked from the newest; tables bucketed by sale."""

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF001
from stockbook.operators import receipts as rc
from stockbook.operators import sales as sl
from stockbook.plans.checks import plan_text
from stockbook.sources import bucketed
from stockbook.sources import testmap as tm
from stockbook.sources.schema import SALES
from stockbook.sources.tables import read_table


def by_month(spark, sales, path):
    sales.withColumn("sale_month", F.date_format("sale_date", "yyyy-MM")).write.partitionBy("sale_month").parquet(path)
    return read_table(spark, path, SALES)


def test_recent_reads_only_the_newest_months(spark, tmp_path):
    s, i = tm.sales(spark, SF001), tm.sale_items(spark, SF001)
    stored = by_month(spark, s, str(tmp_path / "sales"))
    months = [r[0] for r in s.select(F.date_format("sale_date", "yyyy-MM").alias("m")).distinct().orderBy(F.desc("m")).collect()]
    per_month = {r["m"]: r["count"] for r in s.groupBy(F.date_format("sale_date", "yyyy-MM").alias("m")).count().collect()}
    for n in (3, 5, 10, per_month[months[0]], per_month[months[0]] + 1, 10**6):
        got = rc.receipts_recent(stored, i, n)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in rc.receipts_recent(s, i, n).collect()]
        held, last = 0, None
        for m in months:
            held, last = held + per_month[m], m
            if held >= n:
                break
        plan = plan_text(got)
        if held >= n:
            assert any(f"(sale_month#{k}" in plan for k in range(10)) and f">= {last})" in plan
        else:
            assert ">= " not in plan


def test_ties_at_a_months_edge_and_sales_without_date(spark, tmp_path):
    row = lambda i, ts: (i, f"SALE{i}", Decimal("1.00"), ts, "A", None, None, None, None)
    edge = dt.datetime(2024, 2, 1)
    rows = [row(1, edge), row(2, edge), row(3, edge - dt.timedelta(seconds=1)), row(4, edge - dt.timedelta(seconds=1)), row(5, None),
            row(6, edge)]
    s = spark.createDataFrame(rows, SALES.struct)
    i = spark.createDataFrame([], "id bigint, sale_id bigint")
    stored = by_month(spark, s, str(tmp_path / "sales"))
    for n in range(1, 8):
        want = [r["id"] for r in rc.receipts_recent(s, i, n).collect()]
        assert [r["id"] for r in rc.receipts_recent(stored, i, n).collect()] == want
        assert want == [6, 2, 1, 4, 3, 5][:n]


def test_bucketed_tables_join_without_moving(spark, tmp_path):
    s, i = tm.sales(spark, SF001), tm.sale_items(spark, SF001)
    prefix = f"b{uuid.uuid4().hex[:8]}"
    bucketed.write_tables(s, i, prefix, str(tmp_path), 4)
    spark.sql(f"DROP TABLE {prefix}_sales")
    spark.sql(f"DROP TABLE {prefix}_sale_items")          # another session: only the files are left
    bs, bi = bucketed.open_tables(spark, prefix, str(tmp_path), 4)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = sl.item_counts_for(bs, bi, wide=True)
        plan = plan_text(counted)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        lines = bs.join(bi, bs["id"] == bi["sale_id"], "left")
        assert "Exchange" not in plan_text(lines)
        moved = plan_text(sl.item_counts_for(s, i, wide=True))
        assert "Exchange" in moved
        key = lambda r: r["id"]
        want = sorted(sl.item_counts_for(s, i, wide=True).select("id", "item_count").collect(), key=key)
        assert sorted(counted.select("id", "item_count").collect(), key=key) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_sales")
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_sale_items")
    got = rc.receipts_high_value(s, i, 400000)
    assert got.count() > 0
