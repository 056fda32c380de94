"""Inventory views: overview, summary, point-of-sale picker, stock and price
edit lists. Each is a narrow projection of ``products`` (no shuffle); the
summary is one conditional aggregate. Sorting by name is case-insensitive
with the id as tie-break, as the database's collation orders them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def with_stock(products: DataFrame) -> DataFrame:
    """Add ``ppc`` = max(1, ppc) and ``total_pieces`` = containers*ppc + loose."""
    return (products.withColumn("ppc", X.eff_ppc())
            .withColumn("total_pieces", X.total_pieces()))


def _by_name(df: DataFrame, collation: str | None = None) -> DataFrame:
    return df.orderBy(X.collated("product_name", collation), "id")


def inventory_overview(products: DataFrame, collation: str | None = None) -> DataFrame:
    p = with_stock(products)
    value = F.col("total_pieces").cast("decimal(20,0)") * F.col("unit_price")
    return _by_name(p.select(
        "id", "product_name",
        X.php_fallback("model_size", X.NO_VALUE).alias("model_display"),
        "total_pieces",
        X.stock_label_overview().alias("stock_label"),
        "unit_price",
        value.alias("total_value"),
        X.stock_status("total_pieces").alias("status"),
        X.php_fallback("supplier_name", X.NO_VALUE).alias("supplier_display"),
    ), collation)


def inventory_summary(products: DataFrame) -> DataFrame:
    p = with_stock(products)
    t = F.col("total_pieces")
    status = X.stock_status("total_pieces")
    return p.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(status == X.OUT_OF_STOCK).alias("out_of_stock"),
        F.count_if(status == X.LOW_STOCK).alias("low_stock"),
        F.coalesce(F.sum(t.cast("decimal(20,0)") * F.col("unit_price")),
                   F.lit(0).cast("decimal(31,2)")).alias("total_value"),
    )


def pos_product_list(products: DataFrame, collation: str | None = None) -> DataFrame:
    p = with_stock(products)
    return _by_name(p.select(
        "id", "product_name", "unit_price", "total_pieces",
        X.stock_label_pos().alias("stock_label"),
        X.php_fallback("individual_unit", "Piece").alias("individual_unit"),
        F.col("ppc").alias("pieces_per_container"),
        F.concat(F.col("product_name"), F.lit(" - "), X.money_text("unit_price", "$")).alias("option_text"),
    ), collation)


def stock_edit_list(products: DataFrame, collation: str | None = None) -> DataFrame:
    p = with_stock(products)
    return _by_name(p.select(
        "id", "product_name",
        X.stock_label_edit().alias("stock_label"),
        F.coalesce(F.col("container_quantity"), F.lit(0)).cast("int").alias("container_quantity"),
        F.coalesce(F.col("loose_pieces"), F.lit(0)).cast("int").alias("loose_pieces"),
        "total_pieces",
    ), collation)


def price_list(products: DataFrame, collation: str | None = None) -> DataFrame:
    return _by_name(products.select(
        "id", "product_name",
        X.php_fallback("model_size", X.NO_VALUE).alias("model_display"),
        "unit_price",
        X.number_format("unit_price", 2).alias("price_text"),
    ), collation)
