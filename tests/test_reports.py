from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from stockbook.operators import catalog
from stockbook.operators import receipts as rc
from stockbook.operators import sales as sl

SALES = ("id int, sale_number string, total_amount decimal(10,2), sale_date timestamp, staff_name string, "
         "customer_name string, customer_address string, lpo_number string, notes string")
ITEMS = ("id bigint, sale_id int, product_id int, quantity_sold int, unit_type string, "
         "unit_price decimal(10,2), total_price decimal(10,2)")


def _data(spark):
    s = spark.createDataFrame([
        (1, "SALE2024010100000001", Decimal("100.00"), datetime(2024, 1, 1, 0, 5), "A", None, None, None, None),
        (2, "SALE2024010100000002", Decimal("99.99"), datetime(2024, 1, 1, 12, 5), "A", "", None, None, None),
        (3, "SALE2024013100000001", Decimal("250.50"), datetime(2024, 1, 31, 23, 59, 59), "B", "0", None, None, None),
        (4, "SALE2024020100000001", Decimal("10.00"), datetime(2024, 2, 1, 0, 0), "B", "Ann", None, None, None),
        (5, "SALE2024013100000002", Decimal("250.50"), datetime(2024, 1, 31, 23, 59, 59), "B", "Bo", None, None, None),
    ], SALES)
    i = spark.createDataFrame([(10, 1, 7, 1, None, Decimal("1"), Decimal("1")),
                               (11, 1, 8, 2, "Box", Decimal("1"), Decimal("2")),
                               (12, 3, 7, 1, "piece", Decimal("1"), Decimal("1"))], ITEMS)
    p = spark.createDataFrame([(7, "Hot Bolt"), (8, "Nut")], "id int, product_name string")
    return s, i, p


def test_history_range_ends_and_counts(spark):
    s, i, _ = _data(spark)
    rows = sl.sales_history(s, i, "2024-01-01", "2024-01-31").collect()
    assert [r.id for r in rows] == [5, 3, 2, 1]          # newest first, id breaks the tie
    assert {r.id: r.item_count for r in rows} == {5: 0, 3: 1, 2: 0, 1: 2}
    assert {r.id: r.customer_display for r in rows}[3] == "Walk-in Customer"
    assert rows[-1].formatted_date == "2024-01-01 12:05 AM"
    assert [r.id for r in sl.sales_history(s, i, "2024-01-01", "2024-01-31", limit=2).collect()] == [5, 3]


def test_analytics_empty_range_is_zero(spark):
    s, _, _ = _data(spark)
    r = sl.sales_analytics(s, "2030-01-01", "2030-01-31").first()
    assert (r.total_sales, r.total_revenue, r.average_sale, r.highest_sale, r.lowest_sale) == (0, 0, 0, 0, 0)
    r = sl.sales_analytics(s, "2024-01-01", "2024-01-31").first()
    assert r.total_sales == 4 and r.average_sale == Decimal("175.247500")


def test_search_terms(spark):
    s, i, p = _data(spark)
    assert rc.receipts_by_number(s, i, "").count() == 0
    assert rc.receipts_by_number(s, i, "0").count() == 0
    assert rc.receipts_by_number(s, i, " 20240131 ").count() == 2
    assert rc.receipts_by_number(s, i, "%").count() == 5          # wildcards stay wildcards
    assert rc.receipts_by_number(s, i, "sale2024_2").count() == 1  # case-insensitive, _ = one char
    assert rc.receipts_by_number(s, i, "a\\b").count() == 0         # escaped letter, no error
    assert rc.receipts_by_date(s, i, "notadate").count() == 0
    assert rc.receipts_by_date(s, i, "2024-01-31").count() == 2
    assert rc.receipts_by_amount(s, i, "abc").count() == 0
    assert rc.receipts_by_amount(s, i, "250.5").count() == 2
    hv = rc.receipts_high_value(s, i).collect()
    assert [r.id for r in hv] == [5, 3, 1]                     # >= 100, largest first
    prod = {r.id: r.item_count for r in rc.receipts_by_product(s, i, p, "BOLT").collect()}
    assert prod == {1: 1, 3: 1}                                # matching lines only
    summ = rc.receipt_search_summary(rc.receipts_by_date(s, i, "2024-01-31")).first()
    assert summ.receipts_found == 2 and summ.total_value == Decimal("501.00")


def test_receipt_header_by_number_uses_found_sale(spark):
    s, _, _ = _data(spark)
    r = rc.receipt_header(s, sale_number="SALE2024020100000001").first()
    assert r.id == 4 and r.customer_display == "Ann" and r.address_display == "Address not provided"
    r = rc.receipt_header(s, sale_id=3).first()
    assert r.customer_display == "Customer"


def test_dashboard(spark):
    s, _, _ = _data(spark)
    prods = spark.createDataFrame([(1, 2, 3, 6), (2, None, 3, 6), (3, 1, 10, 6)],
                                  "id int, container_quantity int, pieces_per_container int, minimum_stock int")
    r = sl.dashboard_kpis(prods, s, "2024-01-31").first()
    assert (r.total_products, r.today_sales, r.low_stock, r.today_revenue) == (3, 2, 1, Decimal("501.00"))


def test_quick_add_guard(spark):
    adds = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 1, 0), (3, 1, 0, 2)],
                                 "seq long, product_id int, containers int, loose int")
    ok, refused = catalog.quick_add_guard(adds)
    assert [r.seq for r in refused.collect()] == [1]
    assert sorted(r.seq for r in ok.collect()) == [2, 3]


def test_view_today(spark):
    import datetime as dt
    s = spark.createDataFrame([(1, "SALE1", Decimal("1.00"), dt.datetime.combine(dt.date.today(), dt.time(9)),
                                "A", None, None, None, None)], SALES)
    i = spark.createDataFrame([], ITEMS)
    assert [r.id for r in rc.receipts_by_date(s, i).collect()] == [1]


def test_product_form_out_of_range(spark):
    prods = spark.createDataFrame([(1, "Bolt", None, 0, 1, 0)],
                                  "id int, product_name string, model_size string, container_quantity int, "
                                  "pieces_per_container int, loose_pieces int")
    cands = spark.createDataFrame([(1, "Nut", "", "1000000000", "1"), (2, "Pin", "", "5", "3000000000"),
                                   (3, "bolt", "", "5", "1"), (4, "Cap", "0", "2.5", "1")],
                                  "seq long, product_name string, model_size string, unit_price string, "
                                  "container_quantity string")
    got = {r.seq: (r.status, r.message) for r in catalog.new_product_check(prods, cands).collect()}
    assert got[1] == ("invalid", catalog.OUT_OF_RANGE.format("unit_price"))
    assert got[2] == ("invalid", catalog.OUT_OF_RANGE.format("container_quantity"))
    assert got[3] == ("duplicate", None)          # letter case and empty model match
    assert got[4] == ("new", None)                # model '0' reads as no model
