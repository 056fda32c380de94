"""The stream in event time: arrival order does not matter inside the delay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF001
from stockbook.operators import checkout as co
from stockbook.sources import testmap as tm
from stockbook.sources.schema import CARTS
from stockbook.sources.tables import TableStore
from stockbook.streaming import checkout_stream as cs


def write_files(spark, rows, folder, groups):
    """One file per group of rows, named in the order they arrive."""
    folder.mkdir()
    for i, part in enumerate(groups):
        out = folder.parent / f"part{i}"
        spark.createDataFrame([rows[k] for k in part], CARTS).coalesce(1).write.parquet(str(out))
        next(out.glob("*.parquet")).rename(folder / f"{i:03d}.parquet")


def run(spark, tmp_path, rows, groups, delay, prods):
    write_files(spark, rows, tmp_path / "carts", groups)
    store = TableStore(spark, str(tmp_path / "store"))
    cs.seed_store(store, prods)
    q = cs.start(spark, str(tmp_path / "carts"), store.root, str(tmp_path / "ckpt"), "parquet", max_files_per_trigger=1, delay=delay)
    assert q.awaitTermination(600) and q.exception() is None
    return store


def facts(sales):
    return sorted((r["sale_number"], float(r["total_amount"]), r["customer_name"]) for r in sales.collect())


def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path):
    prods = tm.products(spark, SF001).cache()
    carts = (tm.carts(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "cart_id").limit(240)
             .select(*CARTS.names))
    rows = carts.collect()
    # times a minute apart, two carts to a minute, a sub-millisecond apart in places
    start = dt.datetime(2024, 5, 1)
    rows = [tuple(r[c] if c != "ts" else start + dt.timedelta(minutes=i // 2, microseconds=(i % 3) * 400) for c in CARTS.names)
            for i, r in enumerate(rows)]
    close = (10**6, start + dt.timedelta(days=1), "[]", None, None, None, None)     # sells nothing, moves the watermark
    rng = random.Random(5)
    arrival = sorted(range(240), key=lambda i: i // 2 + rng.uniform(0, 25))          # up to 25 minutes out of order
    rows.append(close)
    groups = [arrival[i:i + 60] for i in range(0, 240, 60)] + [[240]]
    store = run(spark, tmp_path, rows, groups, "30 minutes", prods)
    batch = co.checkout(spark.createDataFrame(rows, CARTS), prods)
    assert facts(store.appended("sales")) == facts(batch.sales) and batch.sales.count() > 10
    pair = lambda df: sorted((r["id"], r["container_quantity"], r["loose_pieces"]) for r in df.collect())
    assert pair(store.products()) == pair(batch.products)


def test_late_and_repeated_carts_are_sold(spark, tmp_path):
    prods = spark.createDataFrame([(1, "Bolt", "Box", 10, 1, "Piece", None, None, __import__("decimal").Decimal("1.00"), 0, None, None,
                                    None, None, 0)], tm.products(spark, SF001).schema)
    day = lambda d: dt.datetime(2024, 5, d)
    cart = lambda i, ts, q: (i, ts, f'[{{"product_id": 1, "quantity": {q}}}]', None, None, None, None)
    rows = [cart(1, day(10), 2), cart(1, day(10), 2), cart(2, day(20), 1), cart(3, day(1), 3), cart(4, None, 1), cart(5, day(30), 50)]
    store = run(spark, tmp_path, rows, [[0, 1, 2], [3], [4], [5]], "1 day", prods)
    sold = store.appended("sales")
    assert sorted(float(r["total_amount"]) for r in sold.collect()) == [1.0, 2.0, 2.0, 3.0]     # the cart of now is still held
    assert store.products().first()["container_quantity"] == 2
