from datetime import datetime
from decimal import Decimal

from conftest import SF001
from stockbook.operators.quality import conform_schema, integrity_report, schema_report
from stockbook.sources import testmap as tm
from stockbook.sources.schema import SALE_ITEMS, SALES


def test_conform_adds_missing_columns_in_declared_order(spark):
    old = spark.createDataFrame([(1, "S1", Decimal("5.00"), datetime(2024, 1, 1), "Ann", "x")],
                                "id int, sale_number string, total_amount decimal(10,2), sale_date timestamp, "
                                "staff_name string, extra string")
    out = conform_schema(old, SALES)
    assert out.columns == SALES.names + ["extra"]
    r = out.first()
    assert r.customer_name is None and r.lpo_number is None and r.extra == "x" and r.staff_name == "Ann"
    items = conform_schema(spark.createDataFrame([(1, 1, 1, 2, Decimal("1"), Decimal("2"))],
                                                 "id long, sale_id int, product_id int, quantity_sold int, "
                                                 "unit_price decimal(10,2), total_price decimal(10,2)"), SALE_ITEMS)
    assert items.first().unit_type == "piece"


def test_integrity_counts(spark):
    t = tm.load_all(spark, SF001)
    rep = {(r.table, r.rule, r.column): r.violations
           for r in integrity_report(t["products"], t["sales"], t["sale_items"]).collect()}
    assert rep[("sales", "unique", "sale_number")] == 0
    assert rep[("sale_items", "foreign_key", "product_id")] == 0
    assert rep[("products", "not_null", "loose_pieces")] > 0     # the mapping leaves some NULL


def test_schema_report_missing_table(spark):
    t = tm.load_all(spark, SF001)
    t["sale_items"] = None
    rep = schema_report(spark, t).collect()
    si = [r for r in rep if r.table == "sale_items"]
    assert si and all(r.row_count is None and not r.present for r in si)
    assert {r.row_count for r in rep if r.table == "sales"} == {1500}
