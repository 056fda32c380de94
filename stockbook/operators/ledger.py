"""Replay of stock movements: stock after every event and at the end.

Three kinds of event change a product's stock, each with its own rule:

* ``sale``: ``pieces`` leave the total (containers * ppc + loose); the total
  is clamped at 0 and stored normalised (total div ppc, total mod ppc);
* ``add``: ``containers`` and ``loose`` are added to the stored pair as they
  are, not normalised (amounts are not checked and may be negative);
* ``set``: the stored pair is replaced by (``containers``, ``loose``).

``ppc`` = max(1, pieces_per_container) never changes. Events of unknown
products change nothing. Missing amounts count as 0.

Exact parallel form (no per-product loop): per product in (ts, event_id)
order, a *segment* starts at every set event (segment 0 at the opening
stock). Inside a segment with start value S, let X_n = S + running sum of
deltas (add +c*ppc+l, sale -pieces). The clamp at 0 only acts at sales, so
total_n = X_n - min(0, min over sale rows k <= n of X_k). Running sums and
the running minimum go through ``plans.scan.running_agg``: a plain window per
product, or, when a runtime check finds a product with more rows than a
chunk, a two-level scan that splits it, so one very busy product does not
end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.lineage import cut_lineage, reuse
from ..plans.scan import order_position, running_agg, scan_plan

SALE, ADD, SET = "sale", "add", "set"


def _zero(c: str):
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))


def replay(products: DataFrame, events: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per event of a known product: ``total_after`` (pieces), plus the
    event columns, ``ppc`` and the order position ``seq``."""
    p = products.select(F.col("id").alias("product_id"), X.eff_ppc().alias("ppc"),
                        X.total_pieces().alias("opening_total"))
    ev = (events.select("event_id", "ts", "product_id", "kind", "pieces", "containers", "loose")
          .join(p.select("product_id", "ppc"), "product_id", "inner"))
    ev = order_position(ev, ["ts", "event_id"], "seq")
    n = chunk_rows if chunk_rows else scan_plan(ev, ["product_id"])

    c, l, ppc = _zero("containers"), _zero("loose"), F.col("ppc")
    ev = ev.select(
        "*",
        F.when(F.col("kind") == ADD, c * ppc + l)
         .when(F.col("kind") == SALE, -_zero("pieces"))
         .otherwise(F.lit(0).cast("bigint")).alias("_delta"),
        F.when(F.col("kind") == SET, 1).otherwise(0).alias("_is_set"),
    )
    # read twice below (segment starts and the main path): computed once
    ev = reuse(running_agg(ev, ["product_id"], "seq", {"_seg": ("sum", "_is_set"), "_g": ("sum", "_delta")}, n))

    # start of each segment: the set event itself, or the opening stock
    starts = (ev.where(F.col("kind") == SET)
              .select("product_id", "_seg", (c * ppc + l).alias("_s"), F.col("_g").alias("_gs")))
    ev = (ev.join(starts, ["product_id", "_seg"], "left")
          .join(p.select("product_id", "opening_total"), "product_id", "left")
          .withColumn("_x", F.coalesce("_s", "opening_total") + F.col("_g") - F.coalesce("_gs", F.lit(0)))
          .withColumn("_xs", F.when(F.col("kind") == SALE, F.col("_x"))))
    ev = running_agg(ev, ["product_id", "_seg"], "seq", {"_m": ("min", "_xs")}, n)
    total = F.col("_x") - F.least(F.lit(0).cast("bigint"), F.coalesce(F.col("_m"), F.lit(0).cast("bigint")))
    return ev.select("event_id", "ts", "product_id", "kind", "pieces", "containers", "loose",
                     "ppc", "seq", total.alias("total_after"))


def final_stock(products: DataFrame, replayed: DataFrame) -> DataFrame:
    """Stored (container_quantity, loose_pieces) per product after all events.

    The last sale or set event fixes the pair (normalised total for a sale,
    the given pair for a set; the opening pair, NULL read as 0, when there is
    none); the adds after it are summed on top, un-normalised."""
    fix = (replayed.where(F.col("kind").isin(SALE, SET))
           .groupBy("product_id")
           .agg(F.max_by(F.struct("kind", "total_after", "ppc", "containers", "loose"), F.col("seq")).alias("_f"),
                F.max("seq").alias("_fseq")))
    adds = (replayed.where(F.col("kind") == ADD)
            .join(fix.select("product_id", "_fseq"), "product_id", "left")
            .where(F.col("_fseq").isNull() | (F.col("seq") > F.col("_fseq")))
            .groupBy("product_id")
            .agg(F.sum(_zero("containers")).alias("_ac"), F.sum(_zero("loose")).alias("_al")))
    last = replayed.groupBy("product_id").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    p = products.select(F.col("id").alias("product_id"),
                        _zero("container_quantity").alias("_oc"), _zero("loose_pieces").alias("_ol"))
    f = F.col("_f")
    base_c = (F.when(f["kind"] == SALE, ((f["total_after"] - f["total_after"] % f["ppc"]) / f["ppc"]).cast("bigint"))
              .when(f["kind"] == SET, F.coalesce(f["containers"].cast("bigint"), F.lit(0).cast("bigint")))
              .otherwise(F.col("_oc")))
    base_l = (F.when(f["kind"] == SALE, f["total_after"] % f["ppc"])
              .when(f["kind"] == SET, F.coalesce(f["loose"].cast("bigint"), F.lit(0).cast("bigint")))
              .otherwise(F.col("_ol")))
    out = (last.join(p, "product_id", "inner")
           .join(fix, "product_id", "left")
           .join(adds, "product_id", "left"))
    return out.select(
        "product_id",
        (base_c + F.coalesce("_ac", F.lit(0))).alias("container_quantity"),
        (base_l + F.coalesce("_al", F.lit(0))).alias("loose_pieces"),
        "events", "last_ts")


def apply_final(products: DataFrame, final: DataFrame) -> DataFrame:
    """New products snapshot: changed pairs replaced, ``updated_at`` touched."""
    f = final.select(F.col("product_id").alias("_id"), F.col("container_quantity").alias("_c"),
                     F.col("loose_pieces").alias("_l"), F.col("last_ts").alias("_ts"))
    j = products.join(f, products["id"] == f["_id"], "left")
    cols = []
    for name in products.columns:
        if name == "container_quantity":
            cols.append(F.when(F.col("_id").isNotNull(), F.col("_c").cast("int")).otherwise(F.col(name)).alias(name))
        elif name == "loose_pieces":
            cols.append(F.when(F.col("_id").isNotNull(), F.col("_l").cast("int")).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            cols.append(F.when(F.col("_id").isNotNull(), F.col("_ts").cast(products.schema[name].dataType))
                        .otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return j.select(*cols)


def stock_ledger(products: DataFrame, events: DataFrame, chunk_rows: int | None = None):
    """(per-event totals, final pairs) — the two results of the replay."""
    r = cut_lineage(replay(products, events, chunk_rows))
    return r, final_stock(products, r)
