import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from stockbook.operators import checkout as co
from stockbook.sources import testmap as tm
from stockbook.sources.tables import TableStore
from stockbook.streaming import checkout_stream as cs


def test_stream_equals_batch(spark):
    work = tempfile.mkdtemp(prefix="stockbook-stream-")
    carts = tm.carts(spark, SF001).orderBy("ts", "cart_id").limit(400).cache()
    prods = tm.products(spark, SF001).cache()
    # three files, in request order, one per micro-batch
    ordered = carts.withColumn("_r", F.row_number().over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts", "cart_id")))
    for i, (lo, hi) in enumerate(((1, 150), (151, 300), (301, 400))):
        (ordered.where(F.col("_r").between(lo, hi)).drop("_r").coalesce(1)
         .write.json(os.path.join(work, "in", f"part{i}")))
        os.rename(os.path.join(work, "in", f"part{i}"), os.path.join(work, "in", f"_p{i}"))
    indir = os.path.join(work, "carts")
    os.makedirs(indir)
    for i in range(3):
        src = os.path.join(work, "in", f"_p{i}")
        for f in sorted(os.listdir(src)):
            if f.endswith(".json"):
                os.rename(os.path.join(src, f), os.path.join(indir, f"{i:03d}.json"))
    store = TableStore(spark, os.path.join(work, "store"))
    cs.seed_store(store, prods)
    q = cs.start(spark, indir, store.root, os.path.join(work, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(600)
    assert store.committed() == [0, 1, 2, 3]

    batch = co.checkout(carts, prods)
    got_sales = store.appended("sales")
    assert got_sales.count() == batch.sales.count()
    a = {(r.sale_number, float(r.total_amount)) for r in got_sales.collect()}
    b = {(r.sale_number, float(r.total_amount)) for r in batch.sales.collect()}
    assert a == b
    got_p = {(r.id, r.container_quantity, r.loose_pieces) for r in store.products().collect()}
    want_p = {(r.id, r.container_quantity, r.loose_pieces) for r in batch.products.collect()}
    assert got_p == want_p
    # a replayed batch is skipped
    assert cs.process_batch(store, carts, 0) is False
