"""Skew and invariant checks: a product holding most of the rows is split
into chunks (two-level scans) and still gives the sequential answer."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import bruteforce as bf
from conftest import SF001
from stockbook.operators import checkout as co
from stockbook.operators import inventory as inv
from stockbook.plans.checks import plan_text
from stockbook.plans.scan import running_agg, scan_plan
from stockbook.sources import testmap as tm
from test_checkout import _carts_df, _products_df


def test_hot_product_checkout(spark):
    rnd = random.Random(5)
    prods = {1: dict(id=1, product_name="Hot", container_quantity=40, pieces_per_container=5, loose_pieces=3,
                     unit_price=2), 2: dict(id=2, product_name="Cold", container_quantity=3, pieces_per_container=1,
                                            loose_pieces=0, unit_price=1)}
    t0 = datetime(2024, 5, 1)
    carts = []
    for c in range(1, 301):
        lines = [{"product_id": 1, "quantity": rnd.choice([1, 2, 3]), "unit_type": rnd.choice(["pieces", "box"])}]
        if rnd.random() < 0.2:
            lines.append({"product_id": 2, "quantity": 1})
        carts.append(dict(cart_id=c, ts=t0 + timedelta(seconds=rnd.randint(0, 500)), items=json.dumps(lines)))
    want, after = bf.checkout(carts, prods)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods), chunk_rows=16)
    assert {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()} == want
    st = {r.product_id: (r.container_quantity, r.loose_pieces) for r in res.stock.collect()}
    assert st[1] == (after[1]["container_quantity"], after[1]["loose_pieces"])


def test_two_level_scan_plan_splits_hot_key(spark):
    hot = F.when(F.col("id") < 4900, F.lit(0)).otherwise(F.col("id") % 7 + 1)
    df = spark.range(0, 5000).select(hot.alias("k"), F.col("id").alias("seq"), F.lit(1).alias("v"))
    assert scan_plan(df, ["k"], chunk_rows=100) == 100        # one key holds 98% of rows -> chunks
    out = running_agg(df, ["k"], "seq", {"s": ("sum", "v")}, 100)
    plan = plan_text(out)
    # the row-level window is partitioned by (key, chunk): no task holds the hot key whole
    assert "windowspecdefinition(k#" in plan and "_chunk#" in plan
    assert out.where("k = 0").agg(F.max("s")).first()[0] == 4900
    assert out.where("seq = 1234").first().s == 1235


def test_summary_equals_overview_groups(spark):
    p = tm.products(spark, SF001)
    ov = inv.inventory_overview(p)
    groups = {r.status: r.n for r in ov.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    s = inv.inventory_summary(p).first()
    assert s.out_of_stock == groups.get("Out of Stock", 0)
    assert s.low_stock == groups.get("Low Stock", 0)
    assert s.total_products == sum(groups.values())
    assert s.total_value == ov.agg(F.sum("total_value")).first()[0]
    assert (s.total_products, s.out_of_stock, s.low_stock) == (200, 6, 79)
