"""Replays from stored day summaries against the full replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import bruteforce
from conftest import SF001
from stockbook.operators import ledger, ledger_days as ld
from stockbook.sources import testmap as tm

PRODUCTS = [(1, 5, 4, 3), (2, None, None, None), (3, 0, 1, 0), (4, 2, 7, 20)]
SCHEMA = "event_id long, ts timestamp, product_id int, kind string, pieces int, containers int, loose int"


def make_events(seed, n=300, days=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 3, 1) + dt.timedelta(days=rng.randrange(days), minutes=rng.randrange(1440))
        rows.append((i, ts, rng.choice([1, 1, 1, 2, 3, 4, 9]), rng.choice(["sale", "sale", "sale", "add", "add", "set", "view"]),
                     rng.choice([None, 1, 3, 30]), rng.choice([None, 0, 2, -4]), rng.choice([None, 0, 5, -9])))
    return rows


def frames(spark, rows):
    p = spark.createDataFrame(PRODUCTS, "id int, container_quantity int, pieces_per_container int, loose_pieces int")
    return p, spark.createDataFrame(rows, SCHEMA)


def model(rows):
    products = {i: dict(container_quantity=c, pieces_per_container=p, loose_pieces=l) for i, c, p, l in PRODUCTS}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return products, [dict(zip(names, r, strict=True)) for r in rows]


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, None), (3, 5), (4, None)])
def test_closing_stock_of_every_day(spark, seed, chunk):
    rows = make_events(seed)
    p, ev = frames(spark, rows)
    got = {(r["product_id"], r["day"]): (r["container_quantity"], r["loose_pieces"])
           for r in ld.closing_stock(p, ld.day_summaries(p, ev, chunk)).collect()}
    products, events = model(rows)
    want = {}
    for day in sorted({e["ts"].date() for e in events}):
        _, final = bruteforce.ledger(products, [e for e in events if e["ts"].date() <= day])
        want |= {(i, day): final[i] for i in {e["product_id"] for e in events if e["ts"].date() == day} & set(final)}
    assert got == want


@pytest.mark.parametrize("day", ["2024-02-01", "2024-03-03", "2024-03-06", "2024-12-01"])
def test_resumed_replay_equals_the_full_one(spark, tmp_path, day):
    rows = make_events(7)
    p, ev = frames(spark, rows)
    ld.write_days(ld.day_summaries(p, ev), str(tmp_path / "days"))
    got = ld.resume(p, ld.read_days(spark, str(tmp_path / "days")), ev, day)
    want = ledger.replay(p, ev).where(F.to_date("ts") >= F.lit(day).cast("date"))
    pick = lambda df: sorted((r["event_id"], r["total_after"]) for r in df.collect())
    assert pick(got) == pick(want)


def test_new_and_late_events_touch_their_days_only(spark, tmp_path):
    rows = make_events(9)
    path = str(tmp_path / "days")
    p, ev = frames(spark, rows)
    ld.write_days(ld.day_summaries(p, ev), path)
    more = [(1000, dt.datetime(2024, 3, 2, 7), 1, "set", None, 1, 1), (1001, dt.datetime(2024, 3, 9), 3, "add", None, 4, 4),
            (1002, dt.datetime(2024, 3, 4, 9), 4, "sale", 2, None, None)]
    _, late = frames(spark, more)
    folders = {f: [x.stat().st_mtime_ns for x in (tmp_path / "days" / f).iterdir()] for f in ("day=2024-03-01", "day=2024-03-05")}
    ld.refresh_days(p, ev.union(late), path, late.select(F.to_date("ts").alias("day")))
    assert folders == {f: [x.stat().st_mtime_ns for x in (tmp_path / "days" / f).iterdir()] for f in folders}
    days = ld.read_days(spark, path)
    every = ld.day_summaries(p, ev.union(late))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, days.collect()), key=key) == sorted(map(tuple, every.select(*days.columns).collect()), key=key)


def test_events_without_time_and_nothing(spark):
    p, ev = frames(spark, [(1, None, 1, "set", None, 9, 0), (2, dt.datetime(2024, 3, 1), 1, "sale", 6, None, None)])
    got = [(r["day"], r["total_pieces"]) for r in ld.closing_stock(p, ld.day_summaries(p, ev)).orderBy("day").collect()]
    assert got == [(None, 36), (dt.date(2024, 3, 1), 30)]
    assert ld.stock_before(p, ld.day_summaries(p, ev), "2024-03-01").where("id = 1").first()["container_quantity"] == 9
    p, ev = frames(spark, [])
    assert ld.closing_stock(p, ld.day_summaries(p, ev)).count() == 0
    assert sorted(map(tuple, ld.stock_before(p, ld.day_summaries(p, ev), "2024-03-01").collect())) == sorted(PRODUCTS)


def test_mapped_events(spark):
    p, ev = tm.products(spark, SF001), tm.stock_events(spark, SF001)
    summaries = ld.day_summaries(p, ev)
    last = summaries.agg(F.max("day")).first()[0]
    closing = ld.stock_before(p, summaries, last + dt.timedelta(days=1))
    full = ledger.final_stock(p, ledger.replay(p, ev))
    both = closing.join(full.withColumnRenamed("container_quantity", "c").withColumnRenamed("loose_pieces", "l"),
                        closing["id"] == full["product_id"])
    assert both.count() > 0
    assert both.where("not (container_quantity <=> c and coalesce(loose_pieces, 0) <=> l)").count() == 0
