import random
from datetime import datetime, timedelta

import pytest

import bruteforce as bf
from conftest import SF001
from stockbook.operators import ledger
from stockbook.sources import testmap as tm

PRODUCT_COLS = ("id int, product_name string, container_quantity int, pieces_per_container int, "
                "loose_pieces int, updated_at timestamp")


def _case(seed, n_products=5, n_events=150):
    rnd = random.Random(seed)
    prods = {i: dict(id=i, product_name=f"P{i}", container_quantity=rnd.choice([None, 0, 3, -1]),
                     pieces_per_container=rnd.choice([None, 0, 1, 4, 6]), loose_pieces=rnd.choice([None, 0, 2]))
             for i in range(1, n_products + 1)}
    t0 = datetime(2024, 1, 1)
    evs = [dict(event_id=i, ts=t0 + timedelta(minutes=rnd.randint(0, 40)), product_id=rnd.randint(1, n_products + 1),
                kind=rnd.choice(["sale", "sale", "add", "set", "view"]), pieces=rnd.choice([None, 0, 1, 5, 30]),
                containers=rnd.choice([None, -2, 0, 1, 3]), loose=rnd.choice([None, -1, 0, 2, 7]))
           for i in range(n_events)]
    return prods, evs


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, 4), (3, 7), (4, 1)])
def test_ledger_matches_sequential(spark, seed, chunk):
    prods, evs = _case(seed)
    want_tot, want_final = bf.ledger(prods, evs)
    p = spark.createDataFrame([(v["id"], v["product_name"], v["container_quantity"], v["pieces_per_container"],
                                v["loose_pieces"], None) for v in prods.values()], PRODUCT_COLS)
    e = spark.createDataFrame([(v["event_id"], v["ts"], v["product_id"], v["kind"], v["pieces"], v["containers"],
                                v["loose"]) for v in evs],
                              "event_id long, ts timestamp, product_id int, kind string, pieces int, "
                              "containers int, loose int")
    r, final = ledger.stock_ledger(p, e, chunk_rows=chunk)
    assert {x.event_id: x.total_after for x in r.collect()} == want_tot
    assert {x.product_id: (x.container_quantity, x.loose_pieces) for x in final.collect()} == want_final
    after = ledger.apply_final(p, final)
    got = {x.id: (x.container_quantity, x.loose_pieces) for x in after.collect()}
    for pid, pair in want_final.items():
        assert got[pid] == pair


def test_ledger_on_mapped_events(spark):
    p = tm.products(spark, SF001)
    e = tm.stock_events(spark, SF001)
    want_tot, want_final = bf.ledger({x.id: x.asDict() for x in p.collect()}, [x.asDict() for x in e.collect()])
    r, final = ledger.stock_ledger(p, e, chunk_rows=16)
    assert {x.event_id: x.total_after for x in r.collect()} == want_tot
    assert {x.product_id: (x.container_quantity, x.loose_pieces) for x in final.collect()} == want_final
