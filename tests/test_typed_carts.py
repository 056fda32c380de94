"""Cart payloads whose values are booleans, numbers, text or nested."""

import datetime as dt
import itertools
import json
from decimal import Decimal

import bruteforce
from stockbook.operators import checkout as co

VALUES = ["true", "false", "null", "1", "2", "0", "-1", "1.9", "1e0", '"1"', '"true"', '"2x"', '""', "[]", "[0]", "{}", '{"a":false}',
          "[true, 5]"]
UNITS = ["true", "false", "null", "5", "2.5", '"Box"', '" box "', '"true"', "[]", '["box"]', '{"box":1}', '"a : [b]"']


def payloads():
    out = [f'[{{"product_id": {v}, "quantity": {q}}}]' for v, q in itertools.product(VALUES, ["1", "true", '"1"'])]
    out += [f'[{{"product_id": 1, "quantity": {q}, "unit_type": "piece"}}]' for q in VALUES]
    out += [f'[{{"product_id": 1, "quantity": 1, "unit_type": {u}}}]' for u in UNITS]
    out += [f'[{{"product_id": 1, "quantity": 1}}, {{"product_id": 2, "quantity": 99, "unit_type": {u}}}]' for u in ("[]", "true")]
    out += ["true", "false", "[true]", "[false, null]", '["product_id"]', "[[1, 2]]", '{"b": {"product_id": true, "quantity": 1}, '
            '"a": {"product_id": 2, "quantity": true}}', '{"x": true}', "[{}]", "[{\"product_id\": true, \"quantity\": true}", "[]", "{}"]
    return out


def test_every_type_as_the_server_reads_it(spark):
    t = dt.datetime(2024, 1, 1)
    carts = [dict(cart_id=i, ts=t, items=p) for i, p in enumerate(payloads())]
    prods = {1: dict(id=1, product_name="Bolt", container_quantity=20, pieces_per_container=4, loose_pieces=1, unit_price=Decimal("2.00")),
             2: dict(id=2, product_name="Nut", container_quantity=9, pieces_per_container=1, loose_pieces=0, unit_price=Decimal("1.00"))}
    want, after = bruteforce.checkout(carts, prods)
    c = spark.createDataFrame([(x["cart_id"], t, x["items"], None, None, None, None) for x in carts],
                              "cart_id long, ts timestamp, items string, customer_name string, customer_address string, "
                              "lpo_number string, staff_name string")
    p = spark.createDataFrame([(v["id"], v["product_name"], v["container_quantity"], v["pieces_per_container"], v["loose_pieces"],
                                v["unit_price"], None) for v in prods.values()],
                              "id int, product_name string, container_quantity int, pieces_per_container int, loose_pieces int, "
                              "unit_price decimal(10,2), updated_at timestamp")
    res = co.checkout(c, p)
    got = {r["cart_id"]: (r["accepted"], r["reason"]) for r in res.decisions.collect()}
    assert {carts[i]["items"]: got[i] for i in got} == {carts[i]["items"]: want[i] for i in want}
    stock = {r["id"]: (r["container_quantity"], r["loose_pieces"]) for r in res.products.collect()}
    assert stock == {i: (v["container_quantity"], v["loose_pieces"]) for i, v in after.items()}
    assert sum(a for a, _ in got.values()) > 20


def test_object_payloads_keep_their_order(spark):
    items = json.dumps({"z": {"product_id": 2, "quantity": True}, "a": {"product_id": 1, "quantity": 3}})
    c = spark.createDataFrame([(1, items)], "cart_id long, items string")
    lines, _ = co.parse_carts(c)
    assert [(r["line_pos"], r["product_id"], r["quantity"]) for r in lines.orderBy("line_pos").collect()] == [(1, 2, 1), (2, 1, 3)]
