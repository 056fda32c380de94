import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import bruteforce as bf
from conftest import SF001
from stockbook.operators import checkout as co
from stockbook.sources import testmap as tm

PRODUCT_COLS = ("id int, product_name string, container_unit string, container_quantity int, "
                "pieces_per_container int, individual_unit string, model_size string, description string, "
                "unit_price decimal(10,2), minimum_stock int, supplier_name string, supplier_contact string, "
                "created_at timestamp, updated_at timestamp, loose_pieces int")


def _products_df(spark, prods):
    rows = [(p["id"], p["product_name"], "Box", p["container_quantity"], p["pieces_per_container"], "Piece",
             None, None, bf.money(p["unit_price"]), 5, None, None, None, None, p["loose_pieces"])
            for p in prods.values()]
    return spark.createDataFrame(rows, PRODUCT_COLS)


def _carts_df(spark, carts):
    return spark.createDataFrame(
        [(c["cart_id"], c["ts"], c["items"], None, None, None, None) for c in carts],
        "cart_id long, ts timestamp, items string, customer_name string, customer_address string, "
        "lpo_number string, staff_name string")


def _random_case(seed, n_products=6, n_carts=60):
    rnd = random.Random(seed)
    prods = {}
    for i in range(1, n_products + 1):
        prods[i] = dict(id=i, product_name=f"P{i}", container_quantity=rnd.choice([None, 0, 1, 2, 5]),
                        pieces_per_container=rnd.choice([None, 0, 1, 3, 4]),
                        loose_pieces=rnd.choice([None, 0, 1, 2]), unit_price=rnd.choice([1.5, 2, 10.25]))
    carts = []
    t0 = datetime(2024, 1, 1, 9, 0, 0)
    for c in range(1, n_carts + 1):
        k = rnd.choice([0, 1, 1, 2, 3])
        lines = [dict(product_id=rnd.randint(1, n_products + 1), quantity=rnd.choice([1, 1, 2, 3, 5, 0]),
                      unit_type=rnd.choice(["pieces", "Box", "BOXES", "Gallon", "sack", None]))
                 for _ in range(k)]
        payload = json.dumps(lines)
        if rnd.random() < 0.05:
            payload = rnd.choice(["null", "{}", "not json", "[]"])
        carts.append(dict(cart_id=c, ts=t0 + timedelta(minutes=rnd.randint(0, 30)), items=payload))
    return prods, carts


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, 3), (3, 2), (4, 5)])
def test_checkout_matches_sequential(spark, seed, chunk):
    prods, carts = _random_case(seed)
    want, after = bf.checkout(carts, prods)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods), chunk_rows=chunk)
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    assert got == want
    stock = {r.product_id: (r.container_quantity, r.loose_pieces) for r in res.stock.collect()}
    for pid, (c, l) in stock.items():
        assert (after[pid]["container_quantity"], after[pid]["loose_pieces"]) == (c, l)
    # products without an accepted sale keep their stored values
    for pid in set(prods) - set(stock):
        assert after[pid] == prods[pid]


def test_checkout_outputs_consistent(spark):
    prods, carts = _random_case(7, n_carts=80)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods), chunk_rows=4)
    sales = res.sales.toPandas()
    items = res.sale_items.toPandas()
    dec = res.decisions.toPandas()
    assert len(sales) == int(dec.accepted.sum())
    assert sorted(sales.id.tolist()) == list(range(1, len(sales) + 1))
    by_id = sales.sort_values("id")
    assert by_id.sale_date.is_monotonic_increasing     # ids follow request order
    assert sales.sale_number.is_unique and (sales.sale_number.str.len() == 20).all()
    assert items.id.is_unique
    # header total = sum of its lines; ids follow request order
    tot = items.groupby("sale_id").total_price.sum()
    for r in sales.itertuples():
        assert tot[r.id] == r.total_amount
    assert sorted(items.id) == list(range(1, len(items) + 1))
    # stock never negative
    st = res.stock.toPandas()
    assert (st.container_quantity >= 0).all() and (st.loose_pieces >= 0).all()


def test_checkout_edge_cases(spark):
    prods = {1: dict(id=1, product_name="Bolt", container_quantity=1, pieces_per_container=10,
                     loose_pieces=0, unit_price=2.5),
             2: dict(id=2, product_name="Nut", container_quantity=3, pieces_per_container=1,
                     loose_pieces=0, unit_price=1)}
    t = datetime(2024, 1, 1)
    carts = [
        # same product on two lines that fit alone but not together: accepted (lines not summed)
        dict(cart_id=1, ts=t, items=json.dumps([{"product_id": 1, "quantity": 6}, {"product_id": 1, "quantity": 6}])),
        # container sale oversells and clamps at 0 (check uses the quantity)
        dict(cart_id=2, ts=t + timedelta(seconds=1), items=json.dumps([{"product_id": 2, "quantity": 1, "unit_type": "Box"}])),
        dict(cart_id=3, ts=t + timedelta(seconds=2), items='{}'),
        dict(cart_id=4, ts=t + timedelta(seconds=3), items=json.dumps([{"product_id": "2", "quantity": "2.7"}])),
        dict(cart_id=5, ts=t + timedelta(seconds=4), items=json.dumps([{"product_id": 9, "quantity": 1}])),
        dict(cart_id=6, ts=t + timedelta(seconds=5), items=json.dumps([{"product_id": 1, "quantity": 0}])),
    ]
    want, _ = bf.checkout(carts, prods)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods))
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    assert got == want
    assert got[1] == (True, None)
    assert got[3] == (False, "No items provided.")
    assert got[5] == (False, "Product not found.")
    assert got[6] == (False, "Invalid item entry.")


def test_checkout_on_mapped_carts(spark):
    carts = tm.carts(spark, SF001)
    prods_df = tm.products(spark, SF001)
    res = co.checkout(carts, prods_df)
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    cl = [r.asDict() for r in carts.select("cart_id", "ts", "items").collect()]
    prods = {r.id: r.asDict() for r in prods_df.collect()}
    want, _ = bf.checkout(cl, prods)
    assert got == want
    assert len(got) == 1473


def test_preview_matches_browser_loop(spark):
    prods, carts = _random_case(11, n_carts=40)
    carts = [c for c in carts if c["items"].startswith("[") and c["items"] != "[]"]
    want = bf.preview(carts, prods)
    got = {(r.cart_id, r.line_pos): (r.accepted, r.reason)
           for r in co.cart_preview(_carts_df(spark, carts), _products_df(spark, prods)).collect()}
    assert got == want


def test_parse_carts_lenient_casts(spark):
    carts = [dict(cart_id=1, ts=datetime(2024, 1, 1), items=json.dumps(
        [{"product_id": "3abc", "quantity": "1e3"}, {"product_id": 2.7, "quantity": " 4"}, 5]))]
    lines, empty = co.parse_carts(_carts_df(spark, carts))
    rows = sorted((r.line_pos, r.product_id, r.quantity, r.unit_type, r.line_ok) for r in lines.collect())
    assert rows == [(1, 3, 1000, "pieces", True), (2, 2, 4, "pieces", True), (3, 0, 0, "pieces", False)]
    assert empty.count() == 0


def test_checkout_continues_ids_and_day_numbers(spark):
    from decimal import Decimal
    prods = {1: dict(id=1, product_name="Bolt", container_quantity=100, pieces_per_container=1,
                     loose_pieces=0, unit_price=2)}
    sales = spark.createDataFrame(
        [(41, "SALE2024010100000007", Decimal("2.00"), datetime(2024, 1, 1, 9), "Staff", "", "", "", None),
         (42, "SALE2023123100000003", Decimal("2.00"), datetime(2023, 12, 31, 9), "Staff", "", "", "", None)],
        "id int, sale_number string, total_amount decimal(10,2), sale_date timestamp, staff_name string, "
        "customer_name string, customer_address string, lpo_number string, notes string")
    items = spark.createDataFrame([(500, 41, 1, 1, "piece", Decimal("2"), Decimal("2"))],
                                  "id long, sale_id int, product_id int, quantity_sold int, unit_type string, "
                                  "unit_price decimal(10,2), total_price decimal(10,2)")
    carts = [dict(cart_id=1, ts=datetime(2024, 1, 1, 10), items=json.dumps([{"product_id": 1, "quantity": 2}])),
             dict(cart_id=2, ts=datetime(2024, 1, 2, 10), items=json.dumps([{"product_id": 1, "quantity": 1},
                                                                          {"product_id": 1, "quantity": 1}]))]
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods), sales, items)
    got = {r.cart_id: (r.sale_id, r.sale_number) for r in res.decisions.collect()}
    assert got == {1: (43, "SALE2024010100000008"), 2: (44, "SALE2024010200000001")}
    assert sorted(r.id for r in res.sale_items.collect()) == [501, 502, 503]
    assert (res.last_sale_id, res.last_item_id) == (44, 503)
    tot = {r.id: r.total_amount for r in res.sales.collect()}
    assert tot == {43: Decimal("4.00"), 44: Decimal("4.00")}


def test_checkout_amount_out_of_range_rejects_only_that_cart(spark):
    prods = {1: dict(id=1, product_name="Big", container_quantity=10, pieces_per_container=1, loose_pieces=0,
                     unit_price=60000000), 2: dict(id=2, product_name="Small", container_quantity=10,
                                                   pieces_per_container=1, loose_pieces=0, unit_price=1)}
    t = datetime(2024, 1, 1)
    carts = [dict(cart_id=1, ts=t, items=json.dumps([{"product_id": 1, "quantity": 1}, {"product_id": 1, "quantity": 1}])),
             dict(cart_id=2, ts=t + timedelta(seconds=1), items=json.dumps([{"product_id": 1, "quantity": 2}])),
             dict(cart_id=3, ts=t + timedelta(seconds=2), items=json.dumps([{"product_id": 2, "quantity": 2}]))]
    want, after = bf.checkout(carts, prods)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods))
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    assert got == want
    assert not got[1][0] and "'total_amount'" in got[1][1]
    assert not got[2][0] and "'total_amount'" in got[2][1]
    assert got[3] == (True, None)


@pytest.mark.parametrize("seed,n_products,n_carts,chunk", [(21, 2, 120, 4), (22, 12, 150, None), (23, 3, 200, 7)])
def test_checkout_more_shapes(spark, seed, n_products, n_carts, chunk):
    prods, carts = _random_case(seed, n_products=n_products, n_carts=n_carts)
    want, after = bf.checkout(carts, prods)
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods), chunk_rows=chunk)
    assert {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()} == want
    for r in res.stock.collect():
        assert (after[r.product_id]["container_quantity"], after[r.product_id]["loose_pieces"]) == \
            (r.container_quantity, r.loose_pieces)


def test_carts_refused_by_a_line_of_their_own_stay_out_of_the_admission(spark):
    """A line asking for more than the whole stock refuses its cart whatever
    was sold before; an earlier line of it may still be the reason."""
    prods = {1: dict(id=1, product_name="Bolt", container_quantity=5, pieces_per_container=1, loose_pieces=0, unit_price=2),
             2: dict(id=2, product_name="Nut", container_quantity=3, pieces_per_container=1, loose_pieces=0, unit_price=1),
             3: dict(id=3, product_name=None, container_quantity=1, pieces_per_container=1, loose_pieces=0, unit_price=1)}
    t = datetime(2024, 1, 1)
    lines = [[(1, 6)], [(1, 4)], [(1, 2), (2, 9)], [(2, 9), (1, 2)], [(1, 1), (9, 1)], [(2, 1), (2, 4), (1, 9)], [(1, 2)],
             [(3, 7), (1, 2)], [(3, 7)], [(2, 3)]]
    carts = [dict(cart_id=i, ts=t + timedelta(seconds=i), items=json.dumps([dict(product_id=p, quantity=q) for p, q in x]))
             for i, x in enumerate(lines)]
    res = co.checkout(_carts_df(spark, carts), _products_df(spark, prods))
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    assert got == {0: (False, "Bolt has only 5 available."), 1: (True, None), 2: (False, "Bolt has only 1 available."),
                   3: (False, "Nut has only 3 available."), 4: (False, "Product not found."),
                   5: (False, "Nut has only 3 available."), 6: (False, "Bolt has only 1 available."),
                   # a message without a name is no message; the next one is the reason
                   7: (False, "Bolt has only 1 available."), 8: (False, None), 9: (True, None)}
    rounds = {r.cart_id: r.rounds for r in res.decisions.collect()}
    assert {i for i in rounds if rounds[i]} == {1, 6, 9}
    assert sorted((r.product_id, r.quantity_sold, r.id) for r in res.sale_items.collect()) == [(1, 4, 1), (2, 3, 2)]
