import pytest
from pyspark.sql import functions as F

from stockbook.llm import mixing as M

from . import fixtures


def brute_targets(sizes):
    """Share and reshare until no source is above twice its words."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    weight = {k: M.WEIGHTS[i % 3] for i, k in enumerate(names)}
    left, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in stopped]
        level = left / sum(weight[k] for k in free) if free else 0
        over = [k for k in free if level * weight[k] > 2 * sizes[k]]
        if not over:
            return stopped | {k: level * weight[k] for k in free}
        for k in over:
            stopped[k] = 2.0 * sizes[k]
            left -= stopped[k]


def test_hard_rows(spark):
    rows = fixtures.hard_rows()
    got = M.op3_columns(M.balance(fixtures.hard_docs(spark))).collect()
    assert len(got) == len(rows)
    import re
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for r in rows:
        sums[r[3]] = sums.get(r[3], 0) + size(r[1])
    targets = brute_targets(sums)
    taken, largest = {}, {}
    for r in got:
        assert r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in taken)
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in rows)


def test_tilted_rates_meet_the_constraints(spark):
    docs = spark.createDataFrame([(i, " ".join("w" * (1 + i * 7 % 90)), f"s{i % 3}") for i in range(600)],
                                 "doc_id bigint, text string, source string")
    u = M.units(docs)
    sources = M.stage(M.targets(u.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"),
                                                        F.sum("rows").alias("rows"))))
    rows = u.join(sources.select("source", "s"), "source")
    tilt = M.tilts(M.stage(rows.groupBy("s", "size").agg(F.sum("rows").alias("n"))), sources)
    rate = M._rate(F.col("tilt"), F.col("size") / F.col("mean"), 2)
    met = (rows.join(tilt, "s").groupBy("s").agg(F.sum(F.col("size") * rate).alias("got")).join(sources, "s").collect())
    assert all(r["got"] == pytest.approx(r["target"], rel=1e-5) for r in met)
    assert M.balance(docs).collect().sort() == M.balance(docs.repartition(7)).collect().sort()


def test_mix_repeats_whole_rows(spark):
    docs = fixtures.hard_docs(spark)
    plan = {(r["doc_id"], r["source"], r["size"]): (r["rows"], r["copies"]) for r in M.balance(docs).collect()}
    out = M.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(a * b for a, b in plan.values())


def test_no_rows(spark):
    assert M.balance(fixtures.no_docs(spark)).count() == 0
    assert M.mix(fixtures.no_docs(spark)).count() == 0


def test_every_newton_step_is_a_small_plan(spark, monkeypatch):
    """The driver never plans several steps at once (its memory grew with them)."""
    joins = []
    written = M.stage

    def stage(df, name="t"):
        if name == "tilts":
            joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return written(df, name)

    monkeypatch.setattr(M, "stage", stage)
    docs = spark.createDataFrame([(i, f"s{i % 4}", "w " * (1 + i % 23)) for i in range(200)], "doc_id long, source string, text string")
    rows = M.balance(docs).collect()
    assert len(rows) == 200 and sum(r["copies"] * r["size"] for r in rows) > 0
    assert len(joins) >= M.NEWTON_STEPS and max(joins) == 1
