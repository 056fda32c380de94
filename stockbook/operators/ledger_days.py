"""Stock movements summarised per day, so a replay need not start at the first.

The events of one product on one day act on the stock it opens with as one
function, and such functions compose, so a day's summary is all that later days
need of it. With T the total in pieces that the product opens with:

* a sale of p is T -> max(0, T - p), an add is T -> T + a; after any run of them
  the total is max(T + b, m) for a shift ``b`` and a floor ``m``;
* a set forgets T: the total is a constant from there on.

The stored pair (containers, loose) follows from the last sale or set: a sale
stores its total normalised, a set the pair as given, and adds after it count
on top. A summary therefore is

    kind  'sale', 'set' or 'none': the last sale or set of the day
    b, m  for a sale: the total after it is max(T + b, m); b is NULL if a set
          stands before it on that day
    sc, sl  for a set: the pair
    dc, dl  containers and loose pieces added after it (all day for 'none')

Summaries are stored by day (``write_days``). New events only add their days,
late ones only rewrite theirs (``refresh_days``); any replay then starts from the
summaries of the days before it (``stock_before``, ``resume``).

Within a day, running sums go through ``plans.scan``, so a product with very
many events on one day is split. Across days a product has one row a day, which
is folded in order. Events without a time come first, as in the full replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..plans.scan import order_position, running_agg, scan_plan
from .ledger import ADD, SALE, SET, replay

NONE = "none"
SUMMARY = T.StructType([
    T.StructField("product_id", T.IntegerType()), T.StructField("kind", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in ("b", "m", "sc", "sl", "dc", "dl", "events")],
    T.StructField("last_ts", T.TimestampType()), T.StructField("day", T.DateType())])


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))


def _same_day(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def day_summaries(products: DataFrame, events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """One row per known product and day with events (columns of ``SUMMARY``).
    Events of other kinds change nothing but are counted."""
    p = products.select(F.col("id").alias("product_id"), X.eff_ppc().alias("ppc"))
    ev = (events.select("event_id", "ts", "product_id", "kind", "pieces", "containers", "loose").join(p, "product_id")
          .withColumn("day", F.to_date("ts")))
    ev = order_position(ev, ["ts", "event_id"], "pos")
    c, l, ppc = _zero("containers"), _zero("loose"), F.col("ppc")
    pair = F.struct(c.alias("sc"), l.alias("sl"))
    is_set, is_sale = F.col("kind") == SET, F.col("kind") == SALE
    ends = ev.groupBy("product_id", "day").agg(
        F.max(F.when(is_set, F.col("pos"))).alias("last_set"), F.max(F.when(is_sale, F.col("pos"))).alias("last_sale"),
        F.max_by(F.when(is_set, pair), F.when(is_set, F.col("pos"))).alias("given"),
        F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    # a day without a time keeps its place in the joins
    key = F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date"))
    marks = ends.select(F.col("product_id").alias("_p"), key.alias("_d"), "last_set", "last_sale")
    live = (ev.join(marks, (F.col("product_id") == F.col("_p")) & (key == F.col("_d")))
            .where(F.col("last_set").isNull() | (F.col("pos") > F.col("last_set")))
            .withColumn("_delta", F.when(F.col("kind") == ADD, c * ppc + l).when(is_sale, -_zero("pieces"))
                        .otherwise(F.lit(0).cast("bigint"))))
    n = chunk_rows if chunk_rows else scan_plan(live, ["_p", "_d"])
    live = running_agg(live, ["_p", "_d"], "pos", {"_g": ("sum", "_delta")}, n)
    late = (F.col("kind") == ADD) & (F.col("last_sale").isNull() | (F.col("pos") > F.col("last_sale")))
    moves = live.groupBy("_p", "_d").agg(
        F.max_by(F.when(is_sale, F.col("_g")), F.when(is_sale, F.col("pos"))).alias("_g"),
        F.min(F.when(is_sale, F.col("_g"))).alias("_least"),
        F.sum(F.when(late, c)).alias("dc"), F.sum(F.when(late, l)).alias("dl"))
    p = p.withColumnRenamed("product_id", "_q")
    j = (ends.join(moves, (F.col("product_id") == F.col("_p")) & (key == F.col("_d")), "left")
         .join(p, F.col("product_id") == F.col("_q")))
    sold = F.col("_g").isNotNull()
    from_set = F.col("given.sc") * F.col("ppc") + F.col("given.sl")
    floor = F.col("_g") - F.col("_least")
    return j.select(
        F.col("product_id").cast("int").alias("product_id"),
        F.when(sold, SALE).when(F.col("given").isNotNull(), SET).otherwise(NONE).alias("kind"),
        F.when(F.col("given").isNull(), F.col("_g")).alias("b"),
        F.when(F.col("given").isNull(), floor).otherwise(F.greatest(from_set + F.col("_g"), floor)).alias("m"),
        F.when(~sold, F.col("given.sc")).alias("sc"), F.when(~sold, F.col("given.sl")).alias("sl"),
        F.coalesce("dc", F.lit(0)).cast("bigint").alias("dc"), F.coalesce("dl", F.lit(0)).cast("bigint").alias("dl"),
        "events", F.col("last_ts").cast("timestamp").alias("last_ts"), "day")


def write_days(summaries: DataFrame, path: str) -> None:
    """Store summaries by day; the folders of their days are replaced, all
    others stay."""
    (summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(path)


def refresh_days(products: DataFrame, events: DataFrame, path: str, days: DataFrame) -> None:
    """Summarise the days in ``days (day)`` again, from all of their events.
    Only the events of these days are read past the scan."""
    touched = days.select(F.col("day").alias("_touched")).distinct()
    again = events.join(F.broadcast(touched) if touched.count() <= 100_000 else touched,
                        F.to_date("ts").eqNullSafe(F.col("_touched")), "left_semi")
    write_days(day_summaries(products, again), path)


def _step(state: Column, s: Column, ppc: Column) -> Column:
    """The pair after a day from the pair before it."""
    total = F.when(s["b"].isNull(), s["m"]).otherwise(
        F.greatest(state["c"] * ppc + state["l"] + s["b"], s["m"]))
    left = total % ppc
    c = F.when(s["kind"] == SALE, ((total - left) / ppc).cast("bigint")).when(s["kind"] == SET, s["sc"]).otherwise(state["c"])
    l = F.when(s["kind"] == SALE, left).when(s["kind"] == SET, s["sl"]).otherwise(state["l"])
    return F.struct((c + s["dc"]).alias("c"), (l + s["dl"]).alias("l"))


def _histories(products: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per product its stored pair and its days in order."""
    days = summaries.groupBy("product_id").agg(F.sort_array(F.collect_list(
        F.struct("day", "kind", "b", "m", "sc", "sl", "dc", "dl", "events", "last_ts"))).alias("days"))
    p = products.select(F.col("id").alias("product_id"), X.eff_ppc().alias("ppc"), _zero("container_quantity").alias("c0"),
                        _zero("loose_pieces").alias("l0"))
    return p.join(days, "product_id")


def closing_stock(products: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(product_id, day, container_quantity, loose_pieces, total_pieces,
    events)`` at the end of every summarised day, from the stock ``products``
    had before all of them."""
    start = F.struct(F.struct(F.col("c0").alias("c"), F.col("l0").alias("l")).alias("at"),
                     F.array().cast("array<struct<c:bigint,l:bigint>>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        after = _step(state["at"], s, F.col("ppc"))
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(after)).alias("out"))

    folded = _histories(products, summaries).withColumn("out", F.aggregate("days", start, step, lambda s: s["out"]))
    e = folded.select("product_id", "ppc", F.explode(F.arrays_zip("days", "out")).alias("e"))
    return e.select("product_id", F.col("e.days.day").alias("day"), F.col("e.out.c").alias("container_quantity"),
                    F.col("e.out.l").alias("loose_pieces"),
                    (F.col("e.out.c") * F.col("ppc") + F.col("e.out.l")).alias("total_pieces"),
                    F.col("e.days.events").alias("events"))


def stock_before(products: DataFrame, summaries: DataFrame, day) -> DataFrame:
    """``products`` with the stock they have when ``day`` opens. Products
    without events before it keep theirs."""
    before = summaries.where(F.col("day").isNull() | (F.col("day") < F.lit(day).cast("date")))
    start = F.struct(F.col("c0").alias("c"), F.col("l0").alias("l"))
    pair = _histories(products, before).select(
        F.col("product_id").alias("_id"), F.aggregate("days", start, lambda s, d: _step(s, d, F.col("ppc"))).alias("_pair"))
    j = products.join(pair, products["id"] == pair["_id"], "left")
    new = {"container_quantity": "_pair.c", "loose_pieces": "_pair.l"}
    return j.select(*[F.when(F.col("_id").isNotNull(), F.col(new[c]).cast("int")).otherwise(F.col(c)).alias(c)
                      if c in new else F.col(c) for c in products.columns])


def resume(products: DataFrame, summaries: DataFrame, events: DataFrame, day, chunk_rows: int | None = None) -> DataFrame:
    """The per-event ledger (``ledger.replay``) from ``day`` on, started from
    the summaries of the days before; earlier events are not read."""
    return replay(stock_before(products, summaries, day), events.where(F.to_date("ts") >= F.lit(day).cast("date")), chunk_rows)
