"""Stand-in inputs built from the driver's generated tables.

The application ships no data, so the jobs are exercised on a fixed,
deterministic mapping of the generated tables onto the application schema
(see FIXTURES.md §B). This module only *gives rows in the expected schema*;
it does none of the jobs' work, and no job relies on how the rows are made.

``SQL_CTES`` is the same mapping written for DuckDB; the oracle queries in
``__spark_entry__`` start from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # every supplier delivers; two more remainders leave some products without
    n = s.agg(F.max("s_suppkey").alias("last"))
    j = (p.join(n).withColumn("_key", F.col("p_partkey") % (F.col("last") + 3))
         .join(s, F.col("s_suppkey") == F.col("_key"), "left"))
    k = F.col("p_partkey")
    unit = (F.when(F.col("p_type") == "ECONOMY", "Box").when(F.col("p_type") == "LARGE", "Sack")
            .when(F.col("p_type") == "MEDIUM", "Bundle").when(F.col("p_type") == "PROMO", "Gallon")
            .when(F.col("p_type") == "SMALL", "").otherwise("Piece"))
    size = F.col("p_size")
    return j.select(
        (k + 1).cast("int").alias("id"),
        F.col("p_name").alias("product_name"),
        unit.alias("container_unit"),
        (k % 13).cast("int").alias("container_quantity"),
        F.when(size % 5 == 0, 1).when(size % 7 == 0, 0).otherwise(size).cast("int")
        .alias("pieces_per_container"),
        F.when(k % 6 == 0, "").otherwise("Piece").alias("individual_unit"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(size.cast("string")).alias("model_size"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        (k % 60).cast("int").alias("minimum_stock"),
        F.col("s_name").alias("supplier_name"),
        F.lit(None).cast("string").alias("supplier_contact"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(k % 5).cast("int").alias("loose_pieces"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    k = F.col("o_orderkey")
    return j.select(
        (k + 1).cast("bigint").alias("id"),
        F.concat(F.lit("SALE"), F.date_format("o_orderdate", "yyyyMMdd"),
                 F.lpad(k.cast("string"), 8, "0")).alias("sale_number"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        F.timestamp_add("SECOND", (k * 7919) % 86400, F.col("o_orderdate")).alias("sale_date"),
        F.concat(F.lit("Staff "), (k % 5).cast("string")).alias("staff_name"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.lit(None)).otherwise(F.col("c_name")).alias("customer_name"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("n_name")).alias("customer_address"),
        F.when(k % 3 == 0, F.concat(F.lit("LPO-"), k.cast("string"))).alias("lpo_number"),
        F.lit(None).cast("string").alias("notes"),
    )


# The order of an order's lines.
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")


def _line(partkey: Column, quantity: Column, flag: Column, quantity_name: str = "quantity") -> list[Column]:
    """A line's product, quantity and unit."""
    return [(partkey + 1).cast("int").alias("product_id"), quantity.cast("int").alias(quantity_name),
            F.when(flag == "A", "Box").when(flag == "N", "piece").alias("unit_type")]


def sale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        ((F.col("l_orderkey") + 1) * 100 + F.row_number().over(w)).cast("bigint").alias("id"),
        (F.col("l_orderkey") + 1).cast("bigint").alias("sale_id"),
        *_line(F.col("l_partkey"), F.col("l_quantity"), F.col("l_returnflag"), "quantity_sold"),
        (F.floor(cents / F.col("l_quantity").cast("bigint")).cast("decimal(12,0)") / F.lit(100))
        .cast("decimal(10,2)").alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("total_price"),
    )


def stock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    kind = (F.when(F.col("event_type") == "purchase", "sale")
            .when(F.col("event_type").isin("signup", "click"), "add")
            .when(F.col("event_type") == "error", "set")
            .otherwise(F.col("event_type")))      # a view changes no stock
    return e.select(
        F.col("event_id").cast("bigint"),
        F.col("ts"),
        (F.col("user_id") + 1).cast("int").alias("product_id"),
        kind.alias("kind"),
        (F.floor("value").cast("int") % 20).alias("pieces"),
        (k % 4).alias("containers"),
        (k % 5).alias("loose"),
    )


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cart per sale that has items: its lines as the POS form posts them
    (JSON array of {product_id, quantity, unit_type}, in item-id order)."""
    li = _read(spark, sf_dir, "lineitem")
    s = sales(spark, sf_dir)
    # the lines of an order sorted as sale_items numbers them, in one grouping
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_LINE_ORDER))).alias("_lines"))
    lines = lines.join(s, F.col("l_orderkey") == s["id"] - 1)
    return lines.select(
        F.col("id").alias("cart_id"),
        F.col("sale_date").alias("ts"),
        F.to_json(F.transform("_lines", lambda x: F.struct(
            *_line(x["l_partkey"], x["l_quantity"], x["l_returnflag"])))).alias("items"),
        "customer_name", "customer_address", "lpo_number", "staff_name")


def product_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-product form posts, one per sale line: the line's product again
    (name upper-cased on even ids, another model on every 5th, price 0 on
    every 11th), so the batch holds duplicates, new keys and invalid rows."""
    it = sale_items(spark, sf_dir).select("id", "product_id", "quantity_sold", "unit_type")
    p = products(spark, sf_dir).select(F.col("id").alias("_pid"), "product_name", "model_size",
                                       F.col("unit_price").alias("_price"))
    j = it.join(p, it.product_id == p._pid)
    i = F.col("id")
    return j.select(
        i.alias("seq"),
        F.when(i % 2 == 0, F.upper("product_name")).otherwise(F.col("product_name")).alias("product_name"),
        F.col("unit_type").alias("container_unit"),
        F.col("quantity_sold").cast("string").alias("container_quantity"),
        (i % 4).cast("string").alias("pieces_per_container"),
        F.lit("Piece").alias("individual_unit"),
        F.when(i % 5 == 0, F.concat(F.lit("v"), F.col("quantity_sold").cast("string")))
         .otherwise(F.col("model_size")).alias("model_size"),
        F.when(i % 11 == 0, F.lit("0")).otherwise(F.col("_price").cast("string")).alias("unit_price"),
        F.lit("5").alias("minimum_stock"),
        F.lit(None).cast("string").alias("supplier_name"),
        F.lit(None).cast("string").alias("supplier_contact"),
        F.lit(None).cast("string").alias("description"),
    )


def accented_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The add-product form posts with accents on the names of every third."""
    r = product_requests(spark, sf_dir)
    name = F.translate("product_name", "aeouAEOU", "áèöüÁÈÖÜ")
    return r.withColumn("product_name", F.when(F.col("seq") % 3 == 0, name).otherwise(F.col("product_name")))


def stock_requests(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Stock form posts: the ``add`` (restock) or ``set`` (stock update)
    events as requests in event order."""
    e = stock_events(spark, sf_dir).where(F.col("kind") == kind)
    return e.select(F.col("event_id").alias("seq"), "product_id", "containers", "loose")


def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restock posts of huge amounts, both signs, one per ``add`` event: many
    would take a stock column out of its range, depending on those before."""
    e = stock_events(spark, sf_dir).where(F.col("kind") == "add")
    return e.select(F.col("event_id").alias("seq"), "product_id",
                    ((F.col("containers").cast("bigint") - 1) * 900_000_000).alias("containers"),
                    ((F.col("loose").cast("bigint") - 2) * 800_000_000).alias("loose"))


def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price form posts, one per sale line: the line's unit price, '0' on
    every 7th quantity (refused)."""
    it = sale_items(spark, sf_dir)
    return it.select(F.col("id").alias("seq"), "product_id",
                     F.when(F.col("quantity_sold") % 7 == 0, F.lit("0"))
                      .otherwise(F.col("unit_price").cast("string")).alias("new_price"))


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "products": products(spark, sf_dir),
        "sales": sales(spark, sf_dir),
        "sale_items": sale_items(spark, sf_dir),
    }


# ---------------------------------------------------------------------------
# The same mapping for DuckDB (tables of the driver are pre-registered views).
# ---------------------------------------------------------------------------
SQL_PRODUCTS = """
products AS (
  SELECT CAST(p_partkey + 1 AS INTEGER) AS id,
         p_name AS product_name,
         CASE p_type WHEN 'ECONOMY' THEN 'Box' WHEN 'LARGE' THEN 'Sack' WHEN 'MEDIUM' THEN 'Bundle'
                     WHEN 'PROMO' THEN 'Gallon' WHEN 'SMALL' THEN '' ELSE 'Piece' END AS container_unit,
         CAST(p_partkey % 13 AS INTEGER) AS container_quantity,
         CAST(CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS INTEGER)
           AS pieces_per_container,
         CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'Piece' END AS individual_unit,
         CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS model_size,
         CAST(NULL AS VARCHAR) AS description,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(p_partkey % 60 AS INTEGER) AS minimum_stock,
         s_name AS supplier_name,
         CAST(NULL AS VARCHAR) AS supplier_contact,
         CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 5 END AS INTEGER) AS loose_pieces
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % ((SELECT max(s_suppkey) FROM supplier) + 3)
)"""

SQL_SALES = """
sales AS (
  SELECT CAST(o_orderkey + 1 AS INTEGER) AS id,
         'SALE' || strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS sale_number,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS sale_date,
         'Staff ' || CAST(o_orderkey % 5 AS VARCHAR) AS staff_name,
         CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN NULL ELSE c_name END AS customer_name,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE n_name END AS customer_address,
         CASE WHEN o_orderkey % 3 = 0 THEN 'LPO-' || CAST(o_orderkey AS VARCHAR) END AS lpo_number,
         CAST(NULL AS VARCHAR) AS notes
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
)"""

SQL_SALE_ITEMS = """
sale_items AS (
  SELECT CAST((l_orderkey + 1) * 100 + row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                      l_discount, l_returnflag, l_shipdate) AS BIGINT) AS id,
         CAST(l_orderkey + 1 AS BIGINT) AS sale_id,
         CAST(l_partkey + 1 AS INTEGER) AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity_sold,
         CASE l_returnflag WHEN 'A' THEN 'Box' WHEN 'N' THEN 'piece' END AS unit_type,
         CAST(CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) / CAST(l_quantity AS BIGINT))
              AS DECIMAL(12,0)) / 100 AS DECIMAL(10,2)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS total_price
  FROM lineitem
)"""

SQL_STOCK_EVENTS = """
stock_events AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, ts,
         CAST(user_id + 1 AS INTEGER) AS product_id,
         CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'add'
                         WHEN 'click' THEN 'add' WHEN 'error' THEN 'set' ELSE event_type END AS kind,
         CAST(floor(value) AS INTEGER) % 20 AS pieces,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 AS containers,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 AS loose
  FROM events
)"""

SQL_CTES = {
    "products": SQL_PRODUCTS,
    "sales": SQL_SALES,
    "sale_items": SQL_SALE_ITEMS,
    "stock_events": SQL_STOCK_EVENTS,
}


def with_ctes(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the mapping CTEs it uses. With
    ``recursive`` the list opens with WITH RECURSIVE and ``body`` continues
    it (it starts with a comma and its own CTEs)."""
    order = ["products", "sales", "sale_items", "stock_events"]
    used = [n for n in order if n in names]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(SQL_CTES[n].strip() for n in used) + "\n" + body


__all__ = ["products", "sales", "sale_items", "stock_events", "carts", "product_requests", "accented_requests",
           "stock_requests", "bulk_requests", "price_requests", "load_all", "SQL_CTES", "with_ctes"]
