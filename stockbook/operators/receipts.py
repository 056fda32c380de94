"""Receipt search, quick searches, search summary and the receipt itself.

All searches share one shape: a predicate on ``sales`` -> the number of lines
per selected sale (``sales.item_counts_for``) -> newest first. The product
search is different on purpose: it counts only the lines whose product
matches and drops sales without such a line.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import trigrams
from .sales import TOP_BROADCAST, in_days, item_counts_for, newest_months, today


def _clean_term(q) -> str | None:
    """trim() the term; '' and '0' are refused like ``empty()`` does."""
    if q is None:
        return None
    t = str(q).strip(X.PHP_TRIM_CHARS)
    return None if t in ("", "0") else t


def _none(sales: DataFrame) -> DataFrame:
    return sales.where(F.lit(False))


def _listing(sel: DataFrame, items: DataFrame, bounded: bool = False, wide: bool = False) -> DataFrame:
    return (item_counts_for(sel, items, bounded, wide)
            .withColumn("formatted_date", X.fmt_sale_date("sale_date")))


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("sale_date").desc(), F.col("id").desc())


def _containing(rows: DataFrame, column: str, term: str, index: DataFrame | None, collation: str | None) -> DataFrame:
    if index is None:
        return rows.where(X.contains_collated(column, term, collation))
    if collation:
        raise ValueError("the trigram postings ignore letter case only")
    return trigrams.contains(rows, index, column, term)


def receipts_by_number(sales: DataFrame, items: DataFrame, q, index: DataFrame | None = None,
                       collation: str | None = None) -> DataFrame:
    """Sales whose number contains ``q`` (LIKE '%q%', case-insensitive), found
    through the numbers' trigram postings ``index`` where given."""
    t = _clean_term(q)
    sel = _none(sales) if t is None else _containing(sales, "sale_number", t, index, collation)
    return _newest_first(_listing(sel, items))


def receipts_by_date(sales: DataFrame, items: DataFrame, day=None) -> DataFrame:
    """Sales made on ``day`` (default: today, the "View Today" button); a
    term that is not a date finds nothing."""
    if day is None:
        day = today()
    t = _clean_term(day)
    sel = _none(sales) if t is None else in_days(sales, t, t)
    return _newest_first(_listing(sel, items))


def _amount(term: str | None) -> Decimal | None:
    """The term as an amount a sale can have, else None: not a number, beyond
    the column's range, or with more than two decimals."""
    try:
        val = Decimal(term) if term is not None and "_" not in term else None
    except InvalidOperation:
        val = None
    if val is None or not val.is_finite() or abs(val) >= 10**8 or val.adjusted() < -2 and val != 0:
        return None
    cents = val.quantize(Decimal("0.01"))
    return cents if cents == val else None


def receipts_by_amount(sales: DataFrame, items: DataFrame, amount) -> DataFrame:
    """Sales whose amount equals ``amount``; a non-numeric term finds nothing."""
    val = _amount(_clean_term(amount))
    sel = _none(sales) if val is None else sales.where(F.col("total_amount") == F.lit(val))
    return _newest_first(_listing(sel, items))


def receipts_by_product(sales: DataFrame, items: DataFrame, products: DataFrame, q,
                        index: DataFrame | None = None, collation: str | None = None) -> DataFrame:
    """Sales with at least one line whose product name contains ``q``;
    ``item_count`` counts those matching lines only. ``index``: the trigram
    postings of the product names."""
    t = _clean_term(q)
    if t is None:
        return _newest_first(_listing(_none(sales), items))
    matching = _containing(products, "product_name", t, index, collation).select(F.col("id").alias("product_id"))
    counts = (items.select("sale_id", "product_id", "id")
              .join(matching, "product_id", "left_semi")
              .groupBy("sale_id").agg(F.count("id").alias("item_count")))
    out = sales.join(counts, sales["id"] == counts["sale_id"], "inner").drop(counts["sale_id"])
    return _newest_first(out.withColumn("formatted_date", X.fmt_sale_date("sale_date")))


def receipts_recent(sales: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest sales (10 on the receipts page, 5 and 3 in checks).
    Of a table stored by month only the newest months are read."""
    top = newest_months(sales, n).orderBy(F.col("sale_date").desc(), F.col("id").desc()).limit(n)
    return _newest_first(_listing(top, items, bounded=n <= TOP_BROADCAST))


def receipts_high_value(sales: DataFrame, items: DataFrame, threshold=100) -> DataFrame:
    """Sales with amount >= threshold, largest first. With the page's
    threshold of 100 nearly every sale qualifies, so lines are counted
    before the join (``wide``)."""
    sel = sales.where(F.col("total_amount") >= F.lit(Decimal(str(threshold))))
    return _listing(sel, items, wide=True).orderBy(F.col("total_amount").desc(), F.col("id").desc())


def search_receipts(kind: str, q, sales: DataFrame, items: DataFrame,
                    products: DataFrame | None = None) -> DataFrame:
    """The search form: ``kind`` is sale_number | date | amount | product."""
    if kind == "sale_number":
        return receipts_by_number(sales, items, q)
    if kind == "date":
        return receipts_by_date(sales, items, q)
    if kind == "amount":
        return receipts_by_amount(sales, items, q)
    if kind == "product":
        if products is None:
            raise ValueError("product search needs the products table")
        return receipts_by_product(sales, items, products, q)
    raise ValueError(f"unknown search type {kind!r}")


def receipt_search_summary(result: DataFrame) -> DataFrame:
    """Number of receipts found and their total value (also as the page's
    'GHC 1,234.50' text)."""
    s = result.agg(F.count(F.lit(1)).alias("receipts_found"),
                   F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(20,2)")).alias("total_value"))
    return s.withColumn("total_value_text", X.money_text("total_value", "GHC "))


def receipt_header(sales: DataFrame, sale_id: int | None = None, sale_number: str | None = None) -> DataFrame:
    """One sale by id (> 0), else by number, with the receipt's fallbacks.

    The customer fields come from the sale that was found (also when it was
    found by number)."""
    if sale_id is not None and int(sale_id) > 0:
        sel = sales.where(F.col("id") == F.lit(int(sale_id)))
    elif sale_number is not None and str(sale_number).strip(X.PHP_TRIM_CHARS) != "":
        sel = sales.where(F.col("sale_number") == F.lit(str(sale_number).strip(X.PHP_TRIM_CHARS)))
    else:
        raise ValueError("supply a sale id or a sale number")
    return receipt_headers(sel)


def receipt_headers(sel: DataFrame) -> DataFrame:
    """Receipt header fields for every sale of ``sel`` (batch form)."""
    return sel.select(
        "*",
        X.fmt_sale_date("sale_date").alias("formatted_date"),
        X.php_fallback("customer_name", X.RECEIPT_CUSTOMER).alias("customer_display"),
        X.php_fallback("customer_address", X.RECEIPT_ADDRESS).alias("address_display"),
        F.when(X.php_falsy_str("lpo_number"), F.lit("")).otherwise(F.col("lpo_number")).alias("lpo_display"),
        X.php_fallback("staff_name", X.DEFAULT_STAFF).alias("staff_display"),
    )


def receipt_items(items: DataFrame, products: DataFrame, sale_ids) -> DataFrame:
    """Lines of the given sale(s) with the product name, unit type defaulting
    to 'piece', ordered by line id. ``sale_ids`` is one id or a DataFrame
    with a ``sale_id`` column (batch form)."""
    if isinstance(sale_ids, DataFrame):
        lines = items.join(sale_ids.select("sale_id").distinct(), "sale_id", "left_semi")
    else:
        lines = items.where(F.col("sale_id") == F.lit(int(sale_ids)))
    p = products.select(F.col("id").alias("_pid"), "product_name")
    out = lines.join(p, lines["product_id"] == p["_pid"], "inner").drop("_pid")
    return (out.withColumn("unit_type", F.coalesce(F.col("unit_type"), F.lit("piece")))
            .orderBy("sale_id", "id"))
