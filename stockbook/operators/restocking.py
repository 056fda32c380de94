"""Additions to stock in request order, each refused alone when it overflows.

A request adds containers and loose pieces to what its product holds at that
moment; the database refuses it if either column would leave the INT range, and
the stock stays as it was. Amounts may be negative, so a refusal changes what
later requests find in either direction and the outcome depends on the order.

Three steps, from cheap to exact:

1. per product, the sums of all positive and of all negative amounts: where
   even these stay in range no order can overflow, and the sums are the answer
   (``settled``; one aggregate with map-side combine);
2. elsewhere, running sums per product in request order: everything before
   the first sum out of range is accepted as it stands;
3. from that first refusal on, the next ``FOLD_ROWS`` requests of each such
   product are gathered in order and folded one by one from the exact state;
   what is left goes back to step 2 with the state after the fold.

Running sums are the two-level scans of ``plans.scan``, so a product with very
many requests is split; a fold holds ``FOLD_ROWS`` rows of a product whatever it
has. Each round decides at least that many requests of every product it
touches, so the rounds end; each is checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, reuse
from ..plans.scan import order_position, running_agg, scan_plan

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1
# An amount of this size overflows from any value in range.
BEYOND = 1 << 32
# Requests of one product folded at once; below the row limit up to which
# Spark pushes a per-key row_number limit before the shuffle (1000).
FOLD_ROWS = 512

_OUT = "array<struct<seq:bigint,dc:bigint,dl:bigint,refused:string,c:bigint,l:bigint>>"


def in_int(c: Column) -> Column:
    return c.between(INT_MIN, INT_MAX)


def amount(c: Column) -> Column:
    """An amount cut to what overflows in any case, so sums stay far from the
    range of bigint."""
    return F.greatest(F.lit(-BEYOND), F.least(F.lit(BEYOND), c)).cast("bigint")


def settled(requests: DataFrame) -> DataFrame:
    """Per product: the plain sums, and ``safe``: whether no order of its
    requests ``(product_id, dc, dl, c0, l0)`` can overflow."""
    def side(c: str, sign: int) -> Column:
        return F.sum(F.greatest(F.col(c), F.lit(0)) if sign > 0 else F.least(F.col(c), F.lit(0)))

    s = requests.groupBy("product_id").agg(
        F.first("c0").alias("c0"), F.first("l0").alias("l0"), F.count(F.lit(1)).alias("requests"),
        *[side(c, k).alias(f"_{c}{'+' if k > 0 else '-'}") for c in ("dc", "dl") for k in (1, -1)])
    inside = [(F.col(start) + F.col(f"`_{c}{k}`")) for start, c in (("c0", "dc"), ("l0", "dl")) for k in "+-"]
    safe = reduce(lambda a, b: a & b, [in_int(v) for v in inside])
    return s.select("product_id", "requests", safe.alias("safe"),
                    (F.col("c0") + F.col("`_dc+`") + F.col("`_dc-`")).alias("c"),
                    (F.col("l0") + F.col("`_dl+`") + F.col("`_dl-`")).alias("l"))


def _fold(rows: DataFrame) -> DataFrame:
    """``(product_id, state)`` after the rows ``(product_id, pos, seq, dc, dl,
    sc, sl)`` of each product, from (sc, sl) of its first row."""
    row = F.struct("pos", "seq", "dc", "dl", "sc", "sl")
    groups = rows.groupBy("product_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(state: Column, r: Column) -> Column:
        c, l = state["c"] + r["dc"], state["l"] + r["dl"]
        refused = F.when(~in_int(c), F.lit("container_quantity")).when(~in_int(l), F.lit("loose_pieces"))
        c, l = F.when(refused.isNull(), c).otherwise(state["c"]), F.when(refused.isNull(), l).otherwise(state["l"])
        one = F.struct(r["seq"].alias("seq"), r["dc"].alias("dc"), r["dl"].alias("dl"), refused.alias("refused"),
                       c.alias("c"), l.alias("l"))
        return F.struct(c.alias("c"), l.alias("l"), F.concat(state["out"], F.array(one)).alias("out"))

    first = F.element_at("rows", 1)
    start = F.struct(first["sc"].alias("c"), first["sl"].alias("l"), F.array().cast(_OUT).alias("out"))
    return groups.select("product_id", F.element_at("rows", -1)["pos"].alias("last"),
                         F.aggregate("rows", start, step).alias("state"))


def in_order(requests: DataFrame, fold_rows: int = FOLD_ROWS, chunk_rows: int | None = None) -> DataFrame:
    """Every request ``(product_id, seq, dc, dl, c0, l0)`` with ``refused``,
    the column that would overflow (the first, as the statement sets them; null
    for accepted ones), and the stock ``(c, l)`` after it. Requests run in
    ``seq`` order; (c0, l0), in range, is their product's stock before all of
    them; amounts are cut by ``amount``."""
    ordered = order_position(requests.select("product_id", "seq", "dc", "dl", "c0", "l0"),
                             ["seq", "product_id", "dc", "dl"], "pos")
    keep = ("product_id", "seq", "dc", "dl")
    decided: list[DataFrame] = []
    rest = ordered
    while True:
        n = chunk_rows if chunk_rows else scan_plan(rest, ["product_id"])
        sums = running_agg(rest, ["product_id"], "pos", {"_c": ("sum", "dc"), "_l": ("sum", "dl")}, n)
        sums = reuse(sums.withColumn("c", F.col("c0") + F.col("_c")).withColumn("l", F.col("l0") + F.col("_l")))
        first = cut_lineage(sums.where(~(in_int(F.col("c")) & in_int(F.col("l"))))
                            .groupBy("product_id").agg(F.min("pos").alias("first")))
        marked = sums.join(first, "product_id", "left")
        clear = F.col("first").isNull() | (F.col("pos") < F.col("first"))
        decided.append(cut_lineage(marked.where(clear).select(*keep, F.lit(None).cast("string").alias("refused"), "c", "l")))
        if first.isEmpty():
            break
        # a row's running sum without its own amount is the state it finds, exact up to the first refusal
        tail = marked.where(~clear).select(*keep, "pos", (F.col("c") - F.col("dc")).alias("sc"),
                                           (F.col("l") - F.col("dl")).alias("sl"))
        order = Window.partitionBy("product_id").orderBy("pos")
        head = tail.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= fold_rows).drop("_k")
        folded = cut_lineage(_fold(head))
        out = folded.select("product_id", F.explode("state.out").alias("r"))
        decided.append(out.select("product_id", "r.*"))
        state = folded.select("product_id", "last", F.col("state.c").alias("c0"), F.col("state.l").alias("l0"))
        rest = cut_lineage(tail.join(state, "product_id").where(F.col("pos") > F.col("last"))
                           .select(*keep, "c0", "l0", "pos"))
        if len(decided) >= 16:
            decided = [cut_lineage(reduce(DataFrame.unionByName, decided))]
    return reduce(DataFrame.unionByName, decided)


def totals(requests: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``(product_id, requests, c, l)`` of every product with an accepted
    request: how many were, and its stock after them."""
    sums = reuse(settled(requests))
    plain = sums.where("safe").select("product_id", "requests", "c", "l")
    tight = sums.where(~F.col("safe")).select("product_id")
    if tight.isEmpty():
        return plain
    done = in_order(requests.join(tight, "product_id", "left_semi"), fold_rows).where("refused is null")
    start = requests.join(tight, "product_id", "left_semi").groupBy("product_id").agg(
        F.first("c0").alias("c0"), F.first("l0").alias("l0"))
    after = (done.groupBy("product_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("dc").alias("dc"), F.sum("dl").alias("dl"))
             .join(start, "product_id")
             .select("product_id", "requests", (F.col("c0") + F.col("dc")).alias("c"), (F.col("l0") + F.col("dl")).alias("l")))
    return plain.unionByName(after)
