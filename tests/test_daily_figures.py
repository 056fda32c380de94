"""Analytics from stored day partials, before and after deletes."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF001
from stockbook.operators import daily_figures as df_
from stockbook.operators import sales as sl
from stockbook.plans.checks import plan_text
from stockbook.sources import testmap as tm
from stockbook.sources.tables import delete_cascade

RANGES = [("1997-01-01", "1997-01-31"), ("1997-01-15", "1997-01-15"), ("1900-01-01", "2100-01-01"), ("2050-01-01", "2051-01-01"),
          ("1997-02-01", "1997-01-01"), ("bad", "1997-01-31")]


def test_ranges_and_a_cascade_delete(spark, tmp_path):
    path = str(tmp_path / "days")
    s, i, p = tm.sales(spark, SF001).cache(), tm.sale_items(spark, SF001), tm.products(spark, SF001)
    df_.write_days(df_.day_partials(s), path)
    gone = s.where("total_amount > 400000 or to_date(sale_date) = '1997-01-15' or sale_date >= '1998-12-01'")
    _, left, _ = delete_cascade(p, s, i, sale_ids=gone.select("id"))
    for sales, changed in ((s, None), (left, gone)):
        if changed is not None:
            df_.refresh_days(path, sales, df_.touched_days(changed))
        kept = df_.read_days(spark, path)
        for a, b in RANGES:
            assert df_.analytics(kept, a, b).first() == sl.sales_analytics(sales, a, b).first()
        assert df_.analytics(kept, as_of="1997-01-20").first() == sl.sales_analytics(sales, as_of="1997-01-20").first()
        for day in ("1997-01-15", "1997-01-16"):
            assert df_.dashboard(p, kept, day).first() == sl.dashboard_kpis(p, sales, day).first()


def test_stored_days_prune_months(spark, tmp_path):
    path = str(tmp_path / "days")
    df_.write_days(df_.day_partials(tm.sales(spark, SF001)), path)
    before = {f.name: [x.stat().st_mtime_ns for x in f.iterdir()] for f in (tmp_path / "days").glob("month=*")}
    days = spark.createDataFrame([(dt.date(1997, 1, 15),)], "day date")
    df_.refresh_days(path, tm.sales(spark, SF001).where("false"), days)
    after = {f.name: [x.stat().st_mtime_ns for x in f.iterdir()] for f in (tmp_path / "days").glob("month=*")}
    assert {m for m in before if before[m] != after[m]} == {"month=1997-01"}
    kept = df_.read_days(spark, path)
    assert kept.where("day = '1997-01-15'").first()["sales"] == 0
    assert "PartitionFilters: [isnotnull(month" in plan_text(df_.analytics(kept, "1997-01-01", "1997-02-10"))


def test_sales_without_date_and_nothing(spark):
    schema = "id long, total_amount decimal(10,2), sale_date timestamp"
    import decimal
    rows = [(1, decimal.Decimal("1.10"), None), (2, decimal.Decimal("2.00"), dt.datetime(2024, 1, 1, 23, 59)),
            (3, None, dt.datetime(2024, 1, 1)), (4, decimal.Decimal("0.01"), dt.datetime(2024, 1, 2))]
    s = spark.createDataFrame(rows, schema)
    partials = df_.day_partials(s)
    assert partials.count() == 2
    none = df_.day_partials(spark.createDataFrame([], schema))
    assert df_.analytics(none, "2024-01-01", "2024-01-31").first()["total_sales"] == 0
    for a, b in (("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-02")):
        got, want = df_.analytics(partials, a, b).first(), sl.sales_analytics(s, a, b).first()
        assert got == want


def test_touched_days(spark):
    s = tm.sales(spark, SF001)
    assert df_.touched_days(s.where(F.lit(False))).count() == 0
    assert df_.touched_days(s).count() == df_.day_partials(s).count()
