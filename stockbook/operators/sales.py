"""Sales reports: dashboard figures, sales history and date-range analytics.

Plan notes (checked with ``explain``):
* the date filter is written on ``DATE(sale_date)`` and reaches the Parquet
  scan of a stored sales table as a pushed range on ``sale_date``;
* the history takes its top ``n`` sales *before* counting items, which is
  exact because the sort keys and the filter touch only ``sales`` and the
  left join keeps every sale; the item count then touches only the items of
  those ``n`` sales (a broadcast of at most ``n`` ids);
* dashboard and analytics figures are single-pass conditional aggregates
  (partial aggregation on every partition, one tiny final stage).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def today() -> str:
    """The session's current day (sessions are pinned to UTC)."""
    return _dt.datetime.now(_dt.timezone.utc).date().isoformat()


def _as_date_text(d) -> str:
    if d is None:
        return today()
    if isinstance(d, (_dt.date, _dt.datetime)):
        return d.strftime("%Y-%m-%d")
    return str(d)


def default_range(as_of=None) -> tuple[str, str]:
    """First day of the month of ``as_of`` (default today) .. ``as_of``."""
    day = _dt.date.fromisoformat(_as_date_text(as_of))
    return day.replace(day=1).isoformat(), day.isoformat()


def in_days(sales: DataFrame, date_from, date_to) -> DataFrame:
    """Sales whose day lies in [date_from, date_to]. When the table carries
    the ``sale_month`` partition column (as the table store writes it), the
    matching month range is added, so whole month folders are pruned before
    the pushed ``sale_date`` range filters row groups."""
    cond = X.date_between("sale_date", date_from, date_to)
    if "sale_month" in sales.columns:
        lo = F.date_format(F.lit(str(date_from)).try_cast("date"), "yyyy-MM")
        hi = F.date_format(F.lit(str(date_to)).try_cast("date"), "yyyy-MM")
        cond = cond & F.col("sale_month").between(lo, hi)
    return sales.where(cond)


def newest_months(sales: DataFrame, n: int) -> DataFrame:
    """``sales`` cut to the newest month folders that hold ``n`` dated sales,
    for tables with the ``sale_month`` partition column. The folders are walked
    from the newest, one count of a folder at a time, so the plan that follows
    lists and reads no older one. Months order as days do, so the newest ``n``
    sales are all in these folders, with whatever ties at their edge."""
    if "sale_month" not in sales.columns:
        return sales
    names = {part[len("sale_month="):] for f in sales.inputFiles() for part in f.split("/") if part.startswith("sale_month=")}
    found = 0
    for month in sorted((m for m in names if m[:1].isdigit()), reverse=True):
        found += sales.where(F.col("sale_month") == month).count()
        if found >= n:
            return sales.where(F.col("sale_month") >= month)
    return sales        # fewer dated sales than asked for: those without a date come last


#: Largest top-n whose ids are broadcast.
TOP_BROADCAST = 100_000


def item_counts_for(sel: DataFrame, items: DataFrame, bounded: bool = False,
                    wide: bool = False) -> DataFrame:
    """COUNT(items.id) per sale of ``sel`` (0 when it has none).

    Selective searches: items are reduced to those of the selected sales
    first (semi join; a small selection is broadcast by AQE, so the items
    are not shuffled), then counted. ``bounded`` marks a selection of a known
    small size (a top-n of at most TOP_BROADCAST), which is broadcast. ``wide`` marks a
    selection expected to hold most sales: then the items are counted first
    (partial counts per task, so only one row per sale and task is
    shuffled) and the counts joined, instead of shuffling every item row
    into a semi join. Either way the join is on the unique sale id, so no
    sale row is multiplied.
    """
    if wide:
        counts = items.groupBy("sale_id").agg(F.count("id").alias("item_count"))
    else:
        ids = sel.select(F.col("id").alias("sale_id"))
        if bounded:
            ids = F.broadcast(ids)
        counts = (items.select("sale_id", "id")
                  .join(ids, "sale_id", "left_semi")
                  .groupBy("sale_id").agg(F.count("id").alias("item_count")))
    out = sel.join(counts, sel["id"] == counts["sale_id"], "left").drop(counts["sale_id"])
    return out.withColumn("item_count", F.coalesce(F.col("item_count"), F.lit(0).cast("bigint")))


def _window(date_from, date_to, as_of):
    """Missing ends of a date range, from the default range of ``as_of``."""
    d_from, d_to = default_range(as_of)
    return date_from or d_from, date_to or d_to


def sales_history(sales: DataFrame, items: DataFrame, date_from=None, date_to=None,
                  limit: int = 100, as_of=None) -> DataFrame:
    """Newest ``limit`` sales whose day lies in [date_from, date_to], with
    the 12-hour date text, the number of lines and the customer fallback. A
    missing end is that of the month of ``as_of`` (default today) so far."""
    date_from, date_to = _window(date_from, date_to, as_of)
    in_range = in_days(sales, date_from, date_to)
    top = in_range.orderBy(F.col("sale_date").desc(), F.col("id").desc()).limit(limit)
    out = item_counts_for(top, items, bounded=limit <= TOP_BROADCAST)
    return (out.withColumn("formatted_date", X.fmt_sale_date("sale_date"))
            .withColumn("customer_display", X.php_fallback("customer_name", X.WALK_IN_CUSTOMER))
            .orderBy(F.col("sale_date").desc(), F.col("id").desc()))


def sales_analytics(sales: DataFrame, date_from=None, date_to=None, as_of=None) -> DataFrame:
    """COUNT / SUM / AVG / MAX / MIN of the amounts in the range, each 0 when
    there is no sale. Not limited to the 100 rows of the history. Missing ends
    as in the history."""
    date_from, date_to = _window(date_from, date_to, as_of)
    amt = F.col("total_amount")
    zero = F.lit(0)
    figures = (in_days(sales, date_from, date_to)
               .agg(F.count(F.lit(1)).alias("total_sales"),
                    F.coalesce(F.sum(amt), zero.cast("decimal(20,2)")).alias("total_revenue"),
                    F.coalesce(F.avg(amt), zero.cast("decimal(14,6)")).alias("average_sale"),
                    F.coalesce(F.max(amt), zero.cast("decimal(10,2)")).alias("highest_sale"),
                    F.coalesce(F.min(amt), zero.cast("decimal(10,2)")).alias("lowest_sale")))
    return figures_text(figures)


def figures_text(figures: DataFrame) -> DataFrame:
    """The figures and their cards as the page shows them."""
    return figures.select(
        "*", X.number_format("total_sales", 0).alias("total_sales_text"),
        *[X.money_text(c, "$").alias(f"{c}_text")
          for c in ("total_revenue", "average_sale", "highest_sale", "lowest_sale")])


def dashboard_kpis(products: DataFrame, sales: DataFrame, as_of=None) -> DataFrame:
    """Product count, sales and revenue of the day ``as_of`` (default
    today), and the dashboard's low-stock count (containers * ppc <= minimum,
    loose pieces ignored)."""
    day_text = _as_date_text(as_of)
    p = products.agg(F.count(F.lit(1)).alias("total_products"),
                     F.count_if(X.dashboard_low_stock()).alias("low_stock"))
    of_day = in_days(sales, day_text, day_text)
    s = of_day.agg(F.count(F.lit(1)).alias("today_sales"),
                  F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(20,2)")).alias("today_revenue"))
    # both sides are one-row aggregates; joined on a constant key
    return (p.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k")
            .select("total_products", "today_sales", "low_stock", "today_revenue"))
