"""Additions in request order against the plain loop of the stock page."""

import random

import pytest

from stockbook.operators import catalog, restocking

LOW, HIGH = -(2**31), 2**31 - 1
BIG = [0, 1, -1, 5, 900_000_000, -900_000_000, 2_000_000_000, -2_000_000_000, 2**31 - 1, -(2**31), 2**32, -(2**33), 2**62]


def model(products, requests):
    """products: {id: (name, containers, ppc, loose)}; requests in seq order."""
    stock = {i: [c or 0, l or 0] for i, (_, c, _, l) in products.items()}
    out, accepted = {}, {}
    for seq, pid, dc, dl in sorted(requests):
        if pid not in products:
            out[seq] = ("unknown", None, None, None, None)
            continue
        name, _, ppc, _ = products[pid]
        c, l = stock[pid][0] + dc, stock[pid][1] + dl
        bad = "container_quantity" if not LOW <= c <= HIGH else "loose_pieces" if not LOW <= l <= HIGH else None
        ppc = max(1, ppc or 0)
        if bad:
            c, l = stock[pid]
            out[seq] = ("refused", catalog.MERGE_FAILED + catalog.OUT_OF_RANGE.format(bad), c, l, c * ppc + l)
            continue
        stock[pid] = [c, l]
        accepted[pid] = accepted.get(pid, 0) + 1
        out[seq] = ("added", f"Stock successfully added to existing product '{name}'! Added: {dc} containers + {dl} pieces. "
                             f"New total: {c * ppc + l} pieces.", c, l, c * ppc + l)
    return out, stock, accepted


def frames(spark, products, requests):
    p = spark.createDataFrame([(i, *v) for i, v in products.items()],
                              "id int, product_name string, container_quantity int, pieces_per_container int, loose_pieces int")
    r = spark.createDataFrame([(s, str(pid), str(c), str(l)) for s, pid, c, l in requests],
                              "seq long, product_id string, containers string, loose string")
    return p, r.repartition(3)


PRODUCTS = {1: ("Bolt", 5, 4, 2), 2: ("Nut", None, None, None), 3: ("Pin", HIGH, 1, LOW), 4: ("Cap", 0, 0, 0)}


@pytest.mark.parametrize("seed,fold,chunk", [(1, 512, None), (2, 3, None), (3, 2, 7), (4, 512, 16)])
def test_against_the_loop(spark, monkeypatch, seed, fold, chunk):
    rng = random.Random(seed)
    amount = lambda: rng.choice(BIG)
    # product 1 holds most requests; 9 does not exist
    requests = [(s, rng.choice([1, 1, 1, 1, 2, 3, 4, 9]), amount(), amount()) for s in range(120)]
    p, r = frames(spark, PRODUCTS, requests)
    monkeypatch.setattr(restocking.in_order, "__defaults__", (fold, chunk))
    out, stock, accepted = model(PRODUCTS, requests)
    got = {x["seq"]: (x["status"], x["message"], x["container_quantity"], x["loose_pieces"], x["total_pieces"])
           for x in catalog.restock_requests(p, r).collect()}
    assert got == out
    after, report = catalog.restock(p, r)
    rows = {x["id"]: (x["container_quantity"], x["loose_pieces"]) for x in after.collect()}
    assert rows == {i: tuple(stock[i]) if i in accepted else PRODUCTS[i][1:4:2] for i in PRODUCTS}
    assert {x["product_id"]: (x["requests"], x["container_quantity"], x["loose_pieces"]) for x in report.collect()} == {
        i: (n, *stock[i]) for i, n in accepted.items()}


def test_plain_sums_where_no_order_matters(spark):
    p, r = frames(spark, PRODUCTS, [(1, 1, 3, 1), (2, 1, -8, 0), (3, 3, 1, 0), (4, 3, -1, 0)])
    known = catalog._additions(p, r).where("ppc is not null")
    safe = {x["product_id"]: x["safe"] for x in restocking.settled(known).collect()}
    assert safe == {1: True, 3: False}
    assert catalog.restock(p, r)[0].where("id = 3").first()["container_quantity"] == HIGH - 1     # the first is refused


def test_quick_add_holds_back_empty_requests(spark):
    p, _ = frames(spark, PRODUCTS, [(1, 1, 1, 1)])
    r = spark.createDataFrame([(1, "1", "", " "), (2, "1", "0", "0.0"), (3, "1", "0.5", ""), (4, "1", "x", "0"),
                               (5, "1", None, "2"), (6, "9", None, None)],
                              "seq long, product_id string, containers string, loose string")
    got = {x["seq"]: (x["status"], x["total_pieces"]) for x in catalog.restock_requests(p, r, quick_add=True).collect()}
    assert got == {1: ("nothing", None), 2: ("nothing", None), 3: ("added", 22), 4: ("added", 22), 5: ("added", 24),
                   6: ("nothing", None)}
    none = spark.createDataFrame([], r.schema)
    assert catalog.restock_requests(p, none).count() == 0 and catalog.restock(p, none)[1].count() == 0


def test_requests_without_seq_keep_their_order(spark):
    p, _ = frames(spark, PRODUCTS, [(1, 1, 1, 1)])
    r = spark.createDataFrame([("3", "5", "0"), ("3", "-5", "0"), ("3", "5", "0")],
                              "product_id string, containers string, loose string").coalesce(1)
    assert catalog.restock(p, r)[0].where("id = 3").first()["container_quantity"] == HIGH
