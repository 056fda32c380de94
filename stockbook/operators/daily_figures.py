"""Sales figures kept per day, merged over any range, mended where sales change.

A day's partial is (sales, amounts, sum, min, max): counts and sums add
up, extremes combine, and the average follows from count and sum. So the
analytics of a range, and the dashboard of a day, read one row a day instead of
one a sale.

Deleting sales (with their lines, by cascade) can lower an extreme, which no
partial tells, so the days that lose or gain sales are counted again from their
remaining sales (``refresh_days``) and all others stay as they are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from .sales import _window, figures_text

PARTIALS = T.StructType([
    T.StructField("sales", T.LongType()), T.StructField("amounts", T.LongType()), T.StructField("revenue", T.DecimalType(20, 2)),
    T.StructField("highest", T.DecimalType(10, 2)), T.StructField("lowest", T.DecimalType(10, 2)),
    T.StructField("day", T.DateType())])


def day_partials(sales: DataFrame) -> DataFrame:
    """One row per day with sales (columns of ``PARTIALS``). Sales without a
    date are in no day, as no range holds them."""
    amount = F.col("total_amount")
    return (sales.select(F.to_date("sale_date").alias("day"), "total_amount").where("day is not null").groupBy("day")
            .agg(F.count(F.lit(1)).alias("sales"), F.count(amount).alias("amounts"), F.sum(amount).cast("decimal(20,2)").alias("revenue"),
                 F.max(amount).alias("highest"), F.min(amount).alias("lowest"))
            .select(*PARTIALS.names))


def write_days(partials: DataFrame, path: str) -> None:
    """Store partials, one folder a month; the months they are in are replaced."""
    (partials.withColumn("month", F.date_format("day", "yyyy-MM")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*PARTIALS.fields, T.StructField("month", T.StringType())])).parquet(path)


def touched_days(changed: DataFrame) -> DataFrame:
    """``(day)`` of the sales that come or go."""
    return changed.select(F.to_date("sale_date").alias("day")).where("day is not null").distinct()


def refreshed(partials: DataFrame, sales: DataFrame, days: DataFrame) -> DataFrame:
    """``partials`` with the days in ``days (day)`` counted again from ``sales``;
    a day without sales any more has no row. A day is one row, so the list of
    days is small whatever the sales are; the sales of other days are dropped
    by a semi join before they are aggregated."""
    again = day_partials(sales.join(days.select(F.col("day").alias("_day")), F.to_date("sale_date") == F.col("_day"), "left_semi"))
    kept = partials.select(*PARTIALS.names).join(days.select("day"), "day", "left_anti").select(*PARTIALS.names)
    return kept.unionByName(again)


def refresh_days(path: str, sales: DataFrame, days: DataFrame) -> None:
    """Mend the stored partials of ``days``: their months are written again,
    with the stored rows of their other days. A month that has lost its last
    sale keeps a row of count 0, so that its folder is replaced too."""
    spark = sales.sparkSession
    months = [r[0] for r in days.select(F.date_format("day", "yyyy-MM")).distinct().collect()]   # one a month
    held = read_days(spark, path).where(F.col("month").isin(months)).drop("month")
    new = refreshed(held, sales, days)
    empty = days.join(new.select("day"), "day", "left_anti").select(
        *[F.lit(0).cast("bigint").alias(c) for c in ("sales", "amounts")], F.lit(0).cast("decimal(20,2)").alias("revenue"),
        F.lit(None).cast("decimal(10,2)").alias("highest"), F.lit(None).cast("decimal(10,2)").alias("lowest"), "day")
    # read whole before its folders are replaced; a row a day
    write_days(new.unionByName(empty).checkpoint(), path)


def analytics(partials: DataFrame, date_from=None, date_to=None, as_of=None) -> DataFrame:
    """``sales.sales_analytics`` of a range, from partials."""
    date_from, date_to = _window(date_from, date_to, as_of)
    part = partials.where(F.col("day").between(F.lit(date_from).try_cast("date"), F.lit(date_to).try_cast("date")))
    if "month" in partials.columns:
        low, high = (F.date_format(F.lit(str(d)).try_cast("date"), "yyyy-MM") for d in (date_from, date_to))
        part = part.where(F.col("month").between(low, high))
    n, total, zero = F.coalesce(F.sum("sales"), F.lit(0)), F.sum("revenue"), F.lit(0)
    merged = part.agg(n.cast("bigint").alias("total_sales"), F.sum("amounts").alias("_n"), F.coalesce(total, zero).cast("decimal(20,2)").alias("total_revenue"),
                      F.max("highest").alias("_high"), F.min("lowest").alias("_low"))
    mean = F.col("total_revenue") / F.nullif(F.col("_n"), F.lit(0)).cast("decimal(18,0)")
    figures = merged.select(
        "total_sales", "total_revenue",
        F.coalesce(F.round(mean, 6), zero).cast("decimal(14,6)").alias("average_sale"),
        F.coalesce("_high", zero).cast("decimal(10,2)").alias("highest_sale"),
        F.coalesce("_low", zero).cast("decimal(10,2)").alias("lowest_sale"))
    return figures_text(figures)


def dashboard(products: DataFrame, partials: DataFrame, as_of=None) -> DataFrame:
    """``sales.dashboard_kpis`` of a day, its sales from partials."""
    _, day = _window(None, None, as_of)
    p = products.agg(F.count(F.lit(1)).alias("total_products"), F.count_if(X.dashboard_low_stock()).alias("low_stock"))
    s = (partials.where(F.col("day") == F.lit(day).try_cast("date"))
         .agg(F.coalesce(F.sum("sales"), F.lit(0)).cast("bigint").alias("today_sales"),
              F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(20,2)").alias("today_revenue")))
    return (p.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k")
            .select("total_products", "today_sales", "low_stock", "today_revenue"))
