"""Carts, requests and batches that once lost or doubled rows."""

import datetime as dt
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SF001
from stockbook.functions import exprs as X
from stockbook.operators import catalog, checkout, receipts
from stockbook.plans import lineage
from stockbook.sources import testmap as tm
from stockbook.sources.schema import CARTS, PRODUCTS
from stockbook.sources.tables import TableStore
from stockbook.streaming import checkout_stream as cs


def products(spark):
    row = {f.name: None for f in PRODUCTS.struct.fields}
    rows = [row | {"id": i, "product_name": f"p{i}", "container_quantity": 5, "pieces_per_container": 4,
                   "unit_price": Decimal("2.00"), "loose_pieces": 0} for i in (1, 2)]
    return spark.createDataFrame(rows, PRODUCTS.struct)


def cart(cart_id, items, ts=dt.datetime(2024, 1, 5, 10)):
    return (cart_id, ts, items, None, None, None, None)


def carts(spark, *rows):
    return spark.createDataFrame(rows, CARTS)


def test_cart_without_time_is_sold_now(spark):
    r = checkout.checkout(carts(spark, cart(1, '[{"product_id":1,"quantity":2}]', None),
                                cart(2, '[{"product_id":1,"quantity":1}]')), products(spark))
    sold = {s["id"]: s for s in r.sales.collect()}
    assert set(sold) == {1, 2} and all(s["sale_date"] is not None for s in sold.values())
    assert r.sale_items.agg(F.sum("quantity_sold")).first()[0] == 3
    again = checkout.checkout(carts(spark, cart(3, '[{"product_id":1,"quantity":1}]', None)), products(spark),
                              r.sales, r.sale_items)
    assert [s["id"] for s in again.sales.collect()] == [3]


def test_one_cart_id_twice(spark):
    one = '[{"product_id":1,"quantity":3}]'
    r = checkout.checkout(carts(spark, cart(7, one), cart(7, one), cart(8, '[{"product_id":1,"quantity":99}]')),
                          products(spark))
    assert sorted(s["id"] for s in r.sales.collect()) == [1, 2]
    assert sorted(i["sale_id"] for i in r.sale_items.collect()) == [1, 2]
    assert sorted((d["cart_id"], d["accepted"]) for d in r.decisions.collect()) == [(7, True), (7, True), (8, False)]
    assert r.products.where("id = 1").select(X.total_pieces()).first()[0] == 14


def test_huge_quantity_rejects_only_its_cart(spark):
    huge = '[{"product_id":1,"quantity":9000000000000000000,"unit_type":"Box"},{"product_id":1,"quantity":' + "9" * 30 + '}]'
    both = carts(spark, cart(1, huge), cart(2, '[{"product_id":1,"quantity":2,"unit_type":"Box"}]'))
    r = checkout.checkout(both, products(spark))
    got = {d["cart_id"]: (d["accepted"], d["reason"]) for d in r.decisions.collect()}
    assert got == {1: (False, "p1 has only 20 available."), 2: (True, None)}
    assert r.products.where("id = 1").select(X.total_pieces()).first()[0] == 12
    shown = checkout.cart_preview(both, products(spark)).collect()
    assert [p["accepted"] for p in sorted(shown, key=lambda p: (p["cart_id"], p["line_pos"]))][-1] is True


def test_long_sale_numbers_stay_apart(spark):
    df = spark.createDataFrame([(123456789,), (123456780,), (7,)], "n bigint")
    out = [r[0] for r in df.select(X.sale_number(F.lit("2024-01-01").cast("date"), "n")).collect()]
    assert out == ["SALE20240101123456789", "SALE20240101123456780", "SALE2024010100000007"]


def test_lenient_integers(spark):
    texts = ["9007199254740993", "9" * 25, "-" + "9" * 25, "3abc", "2.7", "1e3", "", None, " 12"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.php_int("t")).collect()]
    assert got == [9007199254740993, 2**63 - 1, -(2**63), 3, 2, 1000, 0, 0, 12]


def test_amounts_no_sale_can_have(spark):
    sales, items = tm.sales(spark, SF001), tm.sale_items(spark, SF001)
    for term in ("1e50", "1_000", "0.001", "nan", "abc", "1e-50"):
        assert receipts.receipts_by_amount(sales, items, term).count() == 0
    amount = sales.first()["total_amount"]
    assert receipts.receipts_by_amount(sales, items, f"{amount}00").count() >= 1


def test_restock_out_of_range_leaves_the_others(spark):
    adds = spark.createDataFrame([(1, "1", "99999999999", "0"), (2, "2", "3", "1")],
                                 "seq int, product_id string, containers string, loose string")
    after, report = catalog.restock(products(spark), adds)
    assert [r["product_id"] for r in report.collect()] == [2]
    assert {r["id"]: r["container_quantity"] for r in after.collect()} == {1: 5, 2: 8}
    after, _ = catalog.set_stock(products(spark), adds)
    assert {r["id"]: r["container_quantity"] for r in after.collect()} == {1: 5, 2: 3}


def test_maintenance_between_micro_batches(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockbook-store-"))
    cs.seed_store(store, products(spark))
    one = lambda i, day=5: carts(spark, cart(i, '[{"product_id":1,"quantity":2}]', dt.datetime(2024, 1, day)))
    assert cs.process_batch(store, one(1), 0)
    adds = spark.createDataFrame([("1", "1", "0")], "product_id string, containers string, loose string")
    store.publish(store.next_batch(), products=catalog.restock(store.products(), adds)[0])
    assert cs.process_batch(store, one(2), 1) and not cs.process_batch(store, one(2), 1)
    assert sorted(r["id"] for r in store.appended("sales").collect()) == [1, 2]
    assert store.products().where("id = 1").select(X.total_pieces()).first()[0] == 20 - 2 + 4 - 2


def test_retry_leaves_nothing_of_a_failed_attempt(spark):
    store = TableStore(spark, tempfile.mkdtemp(prefix="stockbook-store-"))
    cs.seed_store(store, products(spark))
    sold = checkout.checkout(carts(spark, cart(1, '[{"product_id":1,"quantity":2}]')), products(spark))
    failed = sold.sales.withColumn("batch", F.lit(1)).withColumn("sale_month", F.lit("2024-01"))
    failed.write.partitionBy("batch", "sale_month").parquet(f"{store.root}/sales")
    later = checkout.checkout(carts(spark, cart(1, '[{"product_id":1,"quantity":2}]', dt.datetime(2024, 2, 1))),
                              products(spark))
    store.publish(1, products=later.products, appends={"sales": later.sales, "sale_items": later.sale_items})
    assert [r["sale_month"] for r in store.appended("sales").collect()] == ["2024-02"]


def test_release_keeps_a_users_cache(spark):
    mine = spark.range(5).cache()
    mine.count()
    kept = lineage.reuse(spark.range(7))
    kept.count()
    lineage.release()
    assert mine.storageLevel.useMemory and not kept.storageLevel.useMemory
