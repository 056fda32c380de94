"""The registered queries and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, builds the application tables from the
generated tables (``sources.testmap``), runs one library job over the whole
tables and returns its result through ``present.for_compare``. The oracle is
the same question asked in plain SQL of the same tables; where possible it is
written the way the application's own SQL is written (join, group, sort,
limit), not the way the Spark job is planned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.present import for_compare
from ..operators import inventory as inv
from ..operators import receipts as rc
from ..operators import sales as sl
from ..operators import trigrams
from ..sources import testmap as tm
from ..sources.testmap import with_ctes
from .lineage import release

# Parameters of the registered queries (FIXTURES.md §B).
AS_OF = "1997-01-15"
DATE_FROM, DATE_TO = "1997-01-01", "1997-01-31"
NUMBER_TERM = "19970115"
PRODUCT_TERM = "hot bolt"
HIGH_VALUE = 400000
AMOUNT_TERM = "478516.81"
RECENT_N = 10
HEADER_NUMBER = "SALE1997011500000806"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # results kept in memory by earlier queries are not needed any
            # more (they only save recomputation), so one long session
            # running every query does not pile them up
            release()
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark, sf_dir):
    return tm.load_all(spark, sf_dir)


# --- SQL fragments ----------------------------------------------------------
SALE_COLS = """CAST(s.id AS BIGINT) AS id, s.sale_number, CAST(s.total_amount AS DOUBLE) AS total_amount,
  strftime(s.sale_date, '%Y-%m-%d %H:%M:%S') AS sale_date, s.staff_name, s.customer_name,
  s.customer_address, s.lpo_number, s.notes,
  strftime(s.sale_date, '%Y-%m-%d %I:%M %p') AS formatted_date"""
SALE_GROUP = ("s.id, s.sale_number, s.total_amount, s.sale_date, s.staff_name, s.customer_name, "
              "s.customer_address, s.lpo_number, s.notes")


def _falsy(c: str) -> str:
    return f"({c} IS NULL OR {c} IN ('', '0'))"


def _fallback(c: str, d: str) -> str:
    return f"CASE WHEN {_falsy(c)} THEN '{d}' ELSE {c} END"


PPC = "GREATEST(1, COALESCE(pieces_per_container, 0))"
TOTAL = f"(COALESCE(container_quantity, 0) * {PPC} + COALESCE(loose_pieces, 0))"
STATUS = (f"CASE WHEN {TOTAL} = 0 THEN 'Out of Stock' WHEN {TOTAL} <= COALESCE(minimum_stock, 0) "
          f"THEN 'Low Stock' ELSE 'In Stock' END")


def _split_label(show_loose_cond: str) -> str:
    return (f"CAST({TOTAL} // {PPC} AS VARCHAR) || ' ' || {_fallback('container_unit', 'containers')} || "
            f"CASE WHEN {show_loose_cond} THEN ' ' || CAST({TOTAL} % {PPC} AS VARCHAR) || ' pieces' ELSE '' END")


# --- sales reports ----------------------------------------------------------
_DASHBOARD_SQL = with_ctes(f"""
SELECT (SELECT COUNT(*) FROM products) AS total_products,
       (SELECT COUNT(*) FROM sales WHERE CAST(sale_date AS DATE) = DATE '{AS_OF}') AS today_sales,
       (SELECT COUNT(*) FROM products
         WHERE (CAST(container_quantity AS BIGINT) * pieces_per_container) <= minimum_stock) AS low_stock,
       (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) FROM sales
         WHERE CAST(sale_date AS DATE) = DATE '{AS_OF}') AS today_revenue
""", "products", "sales")


@register("dashboard_kpis", _DASHBOARD_SQL)
def q_dashboard_kpis(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(sl.dashboard_kpis(t["products"], t["sales"], AS_OF))


@register("sales_history", with_ctes(f"""
SELECT {SALE_COLS}, COUNT(si.id) AS item_count,
       {_fallback('s.customer_name', 'Walk-in Customer')} AS customer_display
FROM sales s LEFT JOIN sale_items si ON s.id = si.sale_id
WHERE CAST(s.sale_date AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'
GROUP BY {SALE_GROUP}
ORDER BY s.sale_date DESC, s.id DESC
LIMIT 100
""", "sales", "sale_items"))
def q_sales_history(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(sl.sales_history(t["sales"], t["sale_items"], DATE_FROM, DATE_TO, 100))


@register("sales_history_default", with_ctes(f"""
SELECT {SALE_COLS}, COUNT(si.id) AS item_count,
       {_fallback('s.customer_name', 'Walk-in Customer')} AS customer_display
FROM sales s LEFT JOIN sale_items si ON s.id = si.sale_id
WHERE CAST(s.sale_date AS DATE) BETWEEN date_trunc('month', DATE '{AS_OF}') AND DATE '{AS_OF}'
GROUP BY {SALE_GROUP}
ORDER BY s.sale_date DESC, s.id DESC
LIMIT 100
""", "sales", "sale_items"))
def q_sales_history_default(spark, sf_dir):
    """The page opened without dates: from the first of the month to that day."""
    t = _t(spark, sf_dir)
    return for_compare(sl.sales_history(t["sales"], t["sale_items"], as_of=AS_OF))


# average as MySQL keeps it (6 decimals, half up), computed exactly in cents
_AVG6 = ("CAST((2 * SUM(CAST(round(total_amount * 100) AS HUGEINT)) * 10000 + COUNT(*)) "
         "// (2 * COUNT(*)) AS DOUBLE) / 1000000")


# the same average rounded half up to cents, exactly, for the card text
_AVG_CENTS = ("(2 * ((2 * SUM(CAST(round(total_amount * 100) AS HUGEINT)) * 10000 + COUNT(*)) // (2 * COUNT(*)))"
              " + 10000) // 20000")


def _analytics_sql(where: str) -> str:
    return with_ctes(f"""
SELECT total_sales, total_revenue, average_sale, highest_sale, lowest_sale,
       format('{{:,}}', total_sales) AS total_sales_text,
       '$' || format('{{:,.2f}}', total_revenue) AS total_revenue_text,
       '$' || format('{{:,.2f}}', avg_cents / 100.0) AS average_sale_text,
       '$' || format('{{:,.2f}}', highest_sale) AS highest_sale_text,
       '$' || format('{{:,.2f}}', lowest_sale) AS lowest_sale_text
FROM (
  SELECT COUNT(*) AS total_sales,
         CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_revenue,
         COALESCE({_AVG6}, 0) AS average_sale,
         CAST(COALESCE({_AVG_CENTS}, 0) AS BIGINT) AS avg_cents,
         CAST(COALESCE(MAX(total_amount), 0) AS DOUBLE) AS highest_sale,
         CAST(COALESCE(MIN(total_amount), 0) AS DOUBLE) AS lowest_sale
  FROM sales s WHERE {where}
) a
""", "sales")


_IN_RANGE = f"CAST(s.sale_date AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"


@register("sales_analytics", _analytics_sql(_IN_RANGE))
def q_sales_analytics(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(sl.sales_analytics(t["sales"], DATE_FROM, DATE_TO))


@register("sales_analytics_days", _analytics_sql(_IN_RANGE))
def q_sales_analytics_days(spark, sf_dir):
    """The analytics of the range merged from one partial a day."""
    from ..operators import daily_figures as days
    return for_compare(days.analytics(days.day_partials(_t(spark, sf_dir)["sales"]), DATE_FROM, DATE_TO))


@register("sales_analytics_after_delete", _analytics_sql(f"{_IN_RANGE} AND s.total_amount < {HIGH_VALUE}"))
def q_sales_analytics_after_delete(spark, sf_dir):
    """The same after a cascade delete of the high-value sales: only the days
    that lost sales are counted again."""
    from pyspark.sql import functions as F
    from ..operators import daily_figures as days
    from ..sources.tables import delete_cascade
    t = _t(spark, sf_dir)
    gone = t["sales"].where(F.col("total_amount") >= HIGH_VALUE)
    _, left, _ = delete_cascade(t["products"], t["sales"], t["sale_items"], sale_ids=gone.select("id"))
    mended = days.refreshed(days.day_partials(t["sales"]), left, days.touched_days(gone))
    return for_compare(days.analytics(mended, DATE_FROM, DATE_TO))


@register("dashboard_kpis_days", _DASHBOARD_SQL)
def q_dashboard_kpis_days(spark, sf_dir):
    """The dashboard with its sales figures from the day's partial."""
    from ..operators import daily_figures as days
    t = _t(spark, sf_dir)
    return for_compare(days.dashboard(t["products"], days.day_partials(t["sales"]), AS_OF))


# --- receipts ---------------------------------------------------------------
def _listing_sql(where: str, order: str = "s.sale_date DESC, s.id DESC", limit: str = "") -> str:
    return with_ctes(f"""
SELECT {SALE_COLS}, COUNT(si.id) AS item_count
FROM sales s LEFT JOIN sale_items si ON s.id = si.sale_id
{where}
GROUP BY {SALE_GROUP}
ORDER BY {order} {limit}
""", "sales", "sale_items")


@register("receipts_by_number", _listing_sql(f"WHERE s.sale_number ILIKE '%{NUMBER_TERM}%'"))
def q_receipts_by_number(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_by_number(t["sales"], t["sale_items"], NUMBER_TERM))


@register("receipts_by_number_indexed", _listing_sql(f"WHERE s.sale_number ILIKE '%{NUMBER_TERM}%'"))
def q_receipts_by_number_indexed(spark, sf_dir):
    """The same search through the trigram postings of all sale numbers."""
    t = _t(spark, sf_dir)
    index = trigrams.postings(t["sales"], "sale_number")
    return for_compare(rc.receipts_by_number(t["sales"], t["sale_items"], NUMBER_TERM, index))


@register("receipts_by_date", _listing_sql(f"WHERE CAST(s.sale_date AS DATE) = DATE '{AS_OF}'"))
def q_receipts_by_date(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_by_date(t["sales"], t["sale_items"], AS_OF))


@register("receipts_by_amount", _listing_sql(f"WHERE s.total_amount = {AMOUNT_TERM}"))
def q_receipts_by_amount(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_by_amount(t["sales"], t["sale_items"], AMOUNT_TERM))


@register("receipts_by_product", with_ctes(f"""
SELECT {SALE_COLS}, COUNT(si.id) AS item_count
FROM sales s JOIN sale_items si ON s.id = si.sale_id JOIN products p ON si.product_id = p.id
WHERE p.product_name ILIKE '%{PRODUCT_TERM}%'
GROUP BY {SALE_GROUP}
""", "products", "sales", "sale_items"))
def q_receipts_by_product(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_by_product(t["sales"], t["sale_items"], t["products"], PRODUCT_TERM))


@register("receipts_by_product_indexed", ORACLE["receipts_by_product"])
def q_receipts_by_product_indexed(spark, sf_dir):
    """The same search through the trigram postings of all product names."""
    t = _t(spark, sf_dir)
    index = trigrams.postings(t["products"], "product_name")
    return for_compare(rc.receipts_by_product(t["sales"], t["sale_items"], t["products"], PRODUCT_TERM, index))


@register("receipts_by_product_collated", ORACLE["receipts_by_product"])
def q_receipts_by_product_collated(spark, sf_dir):
    """The search for the term with accents, under an accent-insensitive
    collation."""
    from ..functions import exprs as X
    t = _t(spark, sf_dir)
    term = PRODUCT_TERM.upper().replace("O", "Ö")
    return for_compare(rc.receipts_by_product(t["sales"], t["sale_items"], t["products"], term,
                                              collation=X.ACCENT_INSENSITIVE))


@register("receipts_recent", _listing_sql("", limit=f"LIMIT {RECENT_N}"))
def q_receipts_recent(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_recent(t["sales"], t["sale_items"], RECENT_N))


@register("receipts_high_value", _listing_sql(f"WHERE s.total_amount >= {HIGH_VALUE}",
                                              order="s.total_amount DESC, s.id DESC"))
def q_receipts_high_value(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipts_high_value(t["sales"], t["sale_items"], HIGH_VALUE))


@register("receipt_search_summary", with_ctes(f"""
SELECT COUNT(*) AS receipts_found, CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total_value,
       'GHC ' || format('{{:,.2f}}', COALESCE(SUM(total_amount), 0)) AS total_value_text
FROM (SELECT DISTINCT s.id, s.total_amount
      FROM sales s JOIN sale_items si ON s.id = si.sale_id JOIN products p ON si.product_id = p.id
      WHERE p.product_name ILIKE '%{PRODUCT_TERM}%') r
""", "products", "sales", "sale_items"))
def q_receipt_search_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    res = rc.receipts_by_product(t["sales"], t["sale_items"], t["products"], PRODUCT_TERM)
    return for_compare(rc.receipt_search_summary(res))


@register("receipt_header", with_ctes(f"""
SELECT {SALE_COLS},
       {_fallback('s.customer_name', 'Customer')} AS customer_display,
       {_fallback('s.customer_address', 'Address not provided')} AS address_display,
       CASE WHEN {_falsy('s.lpo_number')} THEN '' ELSE s.lpo_number END AS lpo_display,
       {_fallback('s.staff_name', 'Staff')} AS staff_display
FROM sales s WHERE s.sale_number = '{HEADER_NUMBER}'
""", "sales"))
def q_receipt_header(spark, sf_dir):
    t = _t(spark, sf_dir)
    return for_compare(rc.receipt_header(t["sales"], sale_number=HEADER_NUMBER))


@register("receipt_items", with_ctes(f"""
SELECT CAST(si.id AS BIGINT) AS id, CAST(si.sale_id AS BIGINT) AS sale_id,
       CAST(si.product_id AS BIGINT) AS product_id, CAST(si.quantity_sold AS BIGINT) AS quantity_sold,
       COALESCE(si.unit_type, 'piece') AS unit_type, CAST(si.unit_price AS DOUBLE) AS unit_price,
       CAST(si.total_price AS DOUBLE) AS total_price, p.product_name
FROM sale_items si JOIN products p ON p.id = si.product_id
WHERE si.sale_id IN (SELECT id FROM sales WHERE CAST(sale_date AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}')
""", "products", "sales", "sale_items"))
def q_receipt_items(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = t["sales"]
    from ..functions import exprs as X
    sel = s.where(X.date_between("sale_date", DATE_FROM, DATE_TO)).selectExpr("id AS sale_id")
    return for_compare(rc.receipt_items(t["sale_items"], t["products"], sel))


# --- inventory --------------------------------------------------------------
@register("inventory_overview", with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, product_name, {_fallback('model_size', '-')} AS model_display,
       CAST({TOTAL} AS BIGINT) AS total_pieces,
       CASE WHEN {PPC} = 1 THEN CAST({TOTAL} AS VARCHAR) || ' ' || {_fallback('individual_unit', 'pieces')}
            ELSE {_split_label(f'{TOTAL} % {PPC} > 0')} END AS stock_label,
       CAST(unit_price AS DOUBLE) AS unit_price,
       CAST({TOTAL} * unit_price AS DOUBLE) AS total_value,
       {STATUS} AS status,
       {_fallback('supplier_name', '-')} AS supplier_display
FROM products
""", "products"))
def q_inventory_overview(spark, sf_dir):
    return for_compare(inv.inventory_overview(_t(spark, sf_dir)["products"]))


@register("inventory_summary", with_ctes(f"""
SELECT COUNT(*) AS total_products,
       COUNT(*) FILTER (WHERE {STATUS} = 'Out of Stock') AS out_of_stock,
       COUNT(*) FILTER (WHERE {STATUS} = 'Low Stock') AS low_stock,
       CAST(COALESCE(SUM({TOTAL} * unit_price), 0) AS DOUBLE) AS total_value
FROM products
""", "products"))
def q_inventory_summary(spark, sf_dir):
    return for_compare(inv.inventory_summary(_t(spark, sf_dir)["products"]))


@register("pos_product_list", with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, product_name, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST({TOTAL} AS BIGINT) AS total_pieces,
       CASE WHEN {PPC} = 1 THEN CAST({TOTAL} AS VARCHAR) || ' ' || {_fallback('individual_unit', 'pieces')}
            ELSE {_split_label(f'{TOTAL} % {PPC} <> 0')} END AS stock_label,
       {_fallback('individual_unit', 'Piece')} AS individual_unit,
       CAST({PPC} AS BIGINT) AS pieces_per_container,
       product_name || ' - $' || format('{{:,.2f}}', unit_price) AS option_text
FROM products
""", "products"))
def q_pos_product_list(spark, sf_dir):
    return for_compare(inv.pos_product_list(_t(spark, sf_dir)["products"]))


@register("stock_edit_list", with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, product_name,
       CASE WHEN {PPC} = 1 THEN CAST({TOTAL} AS VARCHAR) || ' pieces'
            ELSE {_split_label(f'{TOTAL} % {PPC} > 0')} END AS stock_label,
       CAST(COALESCE(container_quantity, 0) AS BIGINT) AS container_quantity,
       CAST(COALESCE(loose_pieces, 0) AS BIGINT) AS loose_pieces,
       CAST({TOTAL} AS BIGINT) AS total_pieces
FROM products
""", "products"))
def q_stock_edit_list(spark, sf_dir):
    return for_compare(inv.stock_edit_list(_t(spark, sf_dir)["products"]))


@register("price_list", with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, product_name, {_fallback('model_size', '-')} AS model_display,
       CAST(unit_price AS DOUBLE) AS unit_price, format('{{:,.2f}}', unit_price) AS price_text
FROM products
""", "products"))
def q_price_list(spark, sf_dir):
    return for_compare(inv.price_list(_t(spark, sf_dir)["products"]))


# --- stock ledger -----------------------------------------------------------
# Oracle: a recursive walk over each product's events, one event per step,
# carrying the stored (containers, loose) pair exactly as the pages do.
_LEDGER_WALK = """,
p AS (SELECT id, GREATEST(1, COALESCE(pieces_per_container, 0)) AS ppc,
             CAST(COALESCE(container_quantity, 0) AS BIGINT) AS c0,
             CAST(COALESCE(loose_pieces, 0) AS BIGINT) AS l0 FROM products),
ev AS (SELECT e.event_id, e.product_id, e.kind, e.ts,
              CAST(COALESCE(e.pieces, 0) AS BIGINT) AS pieces,
              CAST(COALESCE(e.containers, 0) AS BIGINT) AS containers,
              CAST(COALESCE(e.loose, 0) AS BIGINT) AS loose,
              row_number() OVER (PARTITION BY e.product_id ORDER BY e.ts, e.event_id) AS rn
       FROM stock_events e JOIN p ON p.id = e.product_id),
walk AS (
  SELECT p.id AS product_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id,
         CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS TIMESTAMP) AS ts, p.c0 AS c, p.l0 AS l, p.ppc
  FROM p WHERE p.id IN (SELECT product_id FROM ev)
  UNION ALL
  SELECT ev.product_id, ev.rn, ev.event_id, ev.kind, ev.ts,
         CASE ev.kind WHEN 'sale' THEN GREATEST(0, w.c * w.ppc + w.l - ev.pieces) // w.ppc
                      WHEN 'add' THEN w.c + ev.containers WHEN 'set' THEN ev.containers ELSE w.c END,
         CASE ev.kind WHEN 'sale' THEN GREATEST(0, w.c * w.ppc + w.l - ev.pieces) % w.ppc
                      WHEN 'add' THEN w.l + ev.loose WHEN 'set' THEN ev.loose ELSE w.l END,
         w.ppc
  FROM walk w JOIN ev ON ev.product_id = w.product_id AND ev.rn = w.rn + 1
)
"""


@register("stock_ledger", with_ctes(_LEDGER_WALK + """
SELECT event_id, CAST(product_id AS BIGINT) AS product_id, kind, c * ppc + l AS total_after
FROM walk WHERE rn > 0
""", "products", "stock_events", recursive=True))
def q_stock_ledger(spark, sf_dir):
    from ..operators import ledger
    r = ledger.replay(tm.products(spark, sf_dir), tm.stock_events(spark, sf_dir))
    return for_compare(r.select("event_id", "product_id", "kind", "total_after"))


@register("stock_ledger_final", with_ctes(_LEDGER_WALK + """
SELECT CAST(w.product_id AS BIGINT) AS product_id, w.c AS container_quantity, w.l AS loose_pieces,
       w.rn AS events, strftime(m.last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts
FROM walk w JOIN (SELECT product_id, MAX(rn) AS rn, MAX(ts) AS last_ts FROM walk GROUP BY product_id) m
  ON m.product_id = w.product_id AND m.rn = w.rn
""", "products", "stock_events", recursive=True))
def q_stock_ledger_final(spark, sf_dir):
    from ..operators import ledger
    prods = tm.products(spark, sf_dir)
    _r, final = ledger.stock_ledger(prods, tm.stock_events(spark, sf_dir))
    return for_compare(final)


# the day from which the ledger is resumed
RESUME_DAY = "2024-01-16"


@register("stock_ledger_resumed", with_ctes(_LEDGER_WALK + f"""
SELECT event_id, CAST(product_id AS BIGINT) AS product_id, kind, c * ppc + l AS total_after
FROM walk WHERE rn > 0 AND CAST(ts AS DATE) >= DATE '{RESUME_DAY}'
""", "products", "stock_events", recursive=True))
def q_stock_ledger_resumed(spark, sf_dir):
    """The ledger from a day on, started from the summaries of the days before."""
    from ..operators import ledger_days as ld
    prods, ev = tm.products(spark, sf_dir), tm.stock_events(spark, sf_dir)
    r = ld.resume(prods, ld.day_summaries(prods, ev), ev, RESUME_DAY)
    return for_compare(r.select("event_id", "product_id", "kind", "total_after"))


@register("stock_closing_days", with_ctes(_LEDGER_WALK + """
SELECT CAST(product_id AS BIGINT) AS product_id, strftime(day, '%Y-%m-%d') AS day, c AS container_quantity,
       l AS loose_pieces, c * ppc + l AS total_pieces, events
FROM (SELECT product_id, CAST(ts AS DATE) AS day, arg_max(c, rn) AS c, arg_max(l, rn) AS l, any_value(ppc) AS ppc,
             COUNT(*) AS events FROM walk WHERE rn > 0 GROUP BY product_id, CAST(ts AS DATE))
""", "products", "stock_events", recursive=True))
def q_stock_closing_days(spark, sf_dir):
    """Every product's stock at the end of every day with events."""
    from pyspark.sql import functions as F
    from ..operators import ledger_days as ld
    prods = tm.products(spark, sf_dir)
    days = ld.closing_stock(prods, ld.day_summaries(prods, tm.stock_events(spark, sf_dir)))
    return for_compare(days.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


# --- checkout ---------------------------------------------------------------
_LINES_SQL = """,
l AS (SELECT CAST(sale_id AS BIGINT) AS cart_id,
             CAST(row_number() OVER (PARTITION BY sale_id ORDER BY id) AS BIGINT) AS line_pos,
             CAST(product_id AS BIGINT) AS product_id, CAST(quantity_sold AS BIGINT) AS quantity,
             COALESCE(unit_type, 'pieces') AS unit_type
      FROM sale_items)
"""


@register("cart_lines", with_ctes(_LINES_SQL + """
SELECT cart_id, line_pos, product_id, quantity, unit_type, (product_id > 0 AND quantity > 0) AS line_ok FROM l
""", "sale_items"))
def q_cart_lines(spark, sf_dir):
    from ..operators import checkout as co
    lines, _empty = co.parse_carts(tm.carts(spark, sf_dir))
    return for_compare(lines.select("cart_id", "line_pos", "product_id", "quantity", "unit_type", "line_ok"))


# Oracle: the browser's add-item loop, one line per step within each
# (cart, product), as a recursive walk.
@register("cart_preview", with_ctes(_LINES_SQL + f""",
pp AS (SELECT id, {PPC} AS ppc, {TOTAL} AS stock, unit_price FROM products),
l2 AS (SELECT l.*, pp.ppc, pp.stock, pp.unit_price,
              regexp_matches(l.unit_type, 'box|container|sack|bundle') AS cont,
              CASE WHEN regexp_matches(l.unit_type, 'box|container|sack|bundle') THEN l.quantity * pp.ppc
                   ELSE l.quantity END AS need,
              row_number() OVER (PARTITION BY l.cart_id, l.product_id ORDER BY l.line_pos) AS k
       FROM l JOIN pp ON pp.id = l.product_id),
walk AS (
  SELECT cart_id, product_id, k, line_pos, (need <= stock) AS ok,
         CASE WHEN need <= stock THEN need ELSE 0 END AS used
  FROM l2 WHERE k = 1
  UNION ALL
  SELECT l2.cart_id, l2.product_id, l2.k, l2.line_pos, (w.used + l2.need <= l2.stock),
         w.used + CASE WHEN w.used + l2.need <= l2.stock THEN l2.need ELSE 0 END
  FROM walk w JOIN l2 ON l2.cart_id = w.cart_id AND l2.product_id = w.product_id AND l2.k = w.k + 1)
SELECT l2.cart_id, l2.line_pos, l2.product_id, l2.quantity, l2.unit_type, l2.need AS pieces_needed,
       CAST(CASE WHEN l2.cont THEN l2.unit_price * l2.ppc ELSE l2.unit_price END AS DOUBLE) AS display_price,
       w.ok AS accepted, CASE WHEN w.ok THEN NULL ELSE 'Not enough stock. Need ' || l2.need || ' pieces, but only '
            || (l2.stock - w.used) || ' available.' END AS reason,
       CAST(CASE WHEN w.ok THEN (CASE WHEN l2.cont THEN l2.unit_price * l2.ppc ELSE l2.unit_price END)
                 * l2.quantity END AS DOUBLE) AS line_total
FROM l2 JOIN walk w ON w.cart_id = l2.cart_id AND w.line_pos = l2.line_pos
""", "products", "sale_items", recursive=True))
def q_cart_preview(spark, sf_dir):
    from ..operators import checkout as co
    return for_compare(co.cart_preview(tm.carts(spark, sf_dir), tm.products(spark, sf_dir)))


# Oracle: the server's loop, one cart per step of a recursive walk that carries
# the stock of all products as a list; a cart's first failing line refuses it.
_CHECKOUT_WALK = f""",
pp AS (SELECT CAST(id AS BIGINT) AS id, product_name, unit_price, {PPC} AS ppc, CAST({TOTAL} AS BIGINT) AS stock,
              row_number() OVER (ORDER BY id) AS place FROM products),
cl AS (SELECT si.sale_id AS cart_id, row_number() OVER (PARTITION BY si.sale_id ORDER BY si.id) AS line_pos,
              CAST(si.product_id AS BIGINT) AS product_id, CAST(si.quantity_sold AS BIGINT) AS quantity,
              COALESCE(si.unit_type, 'pieces') AS unit_type, pp.place, pp.product_name, pp.unit_price, pp.ppc,
              CAST(si.quantity_sold AS BIGINT) * CASE
                WHEN regexp_matches(lower(COALESCE(si.unit_type, '')), 'box|container|sack|bundle') THEN pp.ppc ELSE 1 END
                AS pieces,
              CASE WHEN si.quantity_sold <= 0 OR si.product_id <= 0 THEN 'Invalid item entry.'
                   WHEN pp.id IS NULL THEN 'Product not found.' END AS error
       FROM sale_items si LEFT JOIN pp ON pp.id = si.product_id),
cart AS (SELECT row_number() OVER (ORDER BY s.sale_date, s.id) AS seq, s.id AS cart_id, s.sale_date, s.staff_name,
                s.customer_name, s.customer_address, s.lpo_number, l.lines, l.total
         FROM sales s JOIN (SELECT cart_id, SUM(unit_price * quantity) AS total,
                                   list(struct_pack(place := place, quantity := quantity, pieces := pieces, error := error,
                                                    name := product_name) ORDER BY line_pos) AS lines
                            FROM cl GROUP BY cart_id) l ON l.cart_id = s.id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS seq, (SELECT list(stock ORDER BY place) FROM pp) AS stock, CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT seq, CASE WHEN failed IS NULL THEN list_transform(stock, lambda s, i: GREATEST(0, s - COALESCE(list_sum(
                     list_transform(list_filter(lines, lambda l: l.place = i), lambda l: l.pieces)), 0)))
              ELSE stock END,
         CASE WHEN failed IS NOT NULL THEN COALESCE(failed.error, failed.name || ' has only ' || stock[failed.place]
                                                    || ' available.') END
  FROM (SELECT cart.seq, walk.stock, cart.lines, list_filter(cart.lines, lambda l: l.error IS NOT NULL
                     OR l.quantity > walk.stock[l.place])[1] AS failed
        FROM walk JOIN cart ON cart.seq = walk.seq + 1)
),
sold AS (SELECT cart.*, CAST(sale_date AS DATE) AS day, row_number() OVER (ORDER BY seq) AS sale_id,
                'SALE' || strftime(sale_date, '%Y%m%d') || lpad(CAST(row_number() OVER (
                   PARTITION BY CAST(sale_date AS DATE) ORDER BY seq) AS VARCHAR), 8, '0') AS sale_number
         FROM cart JOIN walk USING (seq) WHERE walk.reason IS NULL)
"""


def _checkout(spark, sf_dir):
    from ..operators import checkout as co
    return co.checkout(tm.carts(spark, sf_dir), tm.products(spark, sf_dir))


@register("checkout", with_ctes(_CHECKOUT_WALK + """
SELECT cart.cart_id, walk.reason IS NULL AS accepted, walk.reason, CAST(sold.sale_id AS DOUBLE) AS sale_id,
       sold.sale_number, CAST(sold.total AS DOUBLE) AS total_amount
FROM cart JOIN walk USING (seq) LEFT JOIN sold USING (seq)
""", "products", "sales", "sale_items", recursive=True))
def q_checkout(spark, sf_dir):
    """What becomes of every cart. The sale id of a refused cart is missing, so
    both sides emit it as DOUBLE."""
    from pyspark.sql import functions as F
    d = _checkout(spark, sf_dir).decisions
    return for_compare(d.select("cart_id", "accepted", "reason", F.col("sale_id").cast("double").alias("sale_id"),
                                "sale_number", "total_amount"))


@register("checkout_stock", with_ctes(_CHECKOUT_WALK + """
SELECT pp.id AS product_id, last.stock[pp.place] // pp.ppc AS container_quantity,
       last.stock[pp.place] % pp.ppc AS loose_pieces
FROM pp, (SELECT stock FROM walk ORDER BY seq DESC LIMIT 1) last
WHERE pp.id IN (SELECT product_id FROM cl WHERE cart_id IN (SELECT cart_id FROM sold))
""", "products", "sales", "sale_items", recursive=True))
def q_checkout_stock(spark, sf_dir):
    """The stock of every product that was sold."""
    return for_compare(_checkout(spark, sf_dir).stock.drop("updated_at"))


@register("checkout_sales", with_ctes(_CHECKOUT_WALK + f"""
SELECT sale_id AS id, sale_number, CAST(total AS DOUBLE) AS total_amount,
       strftime(sale_date, '%Y-%m-%d %H:%M:%S') AS sale_date, staff_name, COALESCE(customer_name, '') AS customer_name,
       COALESCE(customer_address, '') AS customer_address, COALESCE(lpo_number, '') AS lpo_number,
       CAST(NULL AS VARCHAR) AS notes
FROM sold
""", "products", "sales", "sale_items", recursive=True))
def q_checkout_sales(spark, sf_dir):
    """The sale headers that checkout appends."""
    return for_compare(_checkout(spark, sf_dir).sales)


@register("checkout_items", with_ctes(_CHECKOUT_WALK + """
SELECT row_number() OVER (ORDER BY sold.seq, cl.line_pos) AS id, sold.sale_id, cl.product_id,
       cl.quantity AS quantity_sold, cl.unit_type, CAST(cl.unit_price AS DOUBLE) AS unit_price,
       CAST(cl.unit_price * cl.quantity AS DOUBLE) AS total_price
FROM cl JOIN sold ON sold.cart_id = cl.cart_id
""", "products", "sales", "sale_items", recursive=True))
def q_checkout_items(spark, sf_dir):
    """The sale lines that checkout appends."""
    return for_compare(_checkout(spark, sf_dir).sale_items)


# --- catalog maintenance -----------------------------------------------------
_REQ_SQL = f""",
pr AS (SELECT p.id AS _pid, p.product_name, p.model_size, p.unit_price AS _price FROM products p),
req AS (SELECT si.id AS seq,
               CASE WHEN si.id % 2 = 0 THEN upper(pr.product_name) ELSE pr.product_name END AS product_name,
               CAST(si.quantity_sold AS BIGINT) AS container_quantity,
               CAST(si.id % 4 AS BIGINT) AS pieces_per_container,
               CASE WHEN si.id % 5 = 0 THEN 'v' || CAST(si.quantity_sold AS VARCHAR) ELSE COALESCE(pr.model_size, '') END
                 AS model_size,
               CASE WHEN si.id % 11 = 0 THEN 0 ELSE CAST(pr._price AS DOUBLE) END AS unit_price,
               COALESCE(si.unit_type, '') AS container_unit
        FROM sale_items si JOIN pr ON si.product_id = pr._pid),
rk AS (SELECT *, lower(product_name) AS kname,
              lower(CASE WHEN model_size IN ('', '0') THEN '' ELSE model_size END) AS kmodel,
              (product_name IN ('', '0') OR unit_price <= 0) AS invalid FROM req),
ex AS (SELECT lower(product_name) AS kname, lower(COALESCE(model_size, '')) AS kmodel,
              arg_min(id, id) AS existing_id, arg_min({TOTAL}, id) AS existing_total
       FROM products GROUP BY 1, 2),
chk AS (SELECT rk.*, ex.existing_id, ex.existing_total,
               CASE WHEN rk.invalid THEN 'invalid' WHEN ex.existing_id IS NOT NULL THEN 'duplicate' ELSE 'new' END
                 AS status
        FROM rk LEFT JOIN ex ON ex.kname = rk.kname AND ex.kmodel = rk.kmodel)
"""


@register("new_product_check", with_ctes(_REQ_SQL + """
SELECT seq, product_name, model_size, status,
       CASE WHEN invalid THEN 'Product name and unit price are required.' END AS message,
       CAST(CASE WHEN NOT invalid THEN existing_id END AS DOUBLE) AS existing_id,
       CAST(CASE WHEN NOT invalid THEN existing_total END AS DOUBLE) AS existing_total,
       CAST(CASE WHEN NOT invalid AND existing_id IS NOT NULL THEN container_quantity * pieces_per_container END
            AS DOUBLE) AS adding_pieces
FROM chk
""", "products", "sale_items"))
def q_new_product_check(spark, sf_dir):
    """Integer columns that are NULL for new or invalid requests are emitted
    as DOUBLE on both sides, so engines agree on how a missing integer looks."""
    from pyspark.sql import functions as F
    from ..operators import catalog
    out = catalog.new_product_check(tm.products(spark, sf_dir), tm.product_requests(spark, sf_dir))
    out = out.select(*[F.col(c).cast("double").alias(c) if c in ("existing_id", "existing_total", "adding_pieces")
                       else F.col(c) for c in out.columns])
    return for_compare(out)


# the same requests with accents; names and models equal without them are equal
_ACCENT_SQL = (_REQ_SQL.replace("END AS product_name,", "END AS plain_name,")
               .replace("rk AS (SELECT *,", "rq AS (SELECT *, CASE WHEN seq % 3 = 0 THEN translate(plain_name, 'aeouAEOU', 'áèöüÁÈÖÜ') "
                        "ELSE plain_name END AS product_name FROM req),\nrk AS (SELECT *,")
               .replace("AS invalid FROM req)", "AS invalid FROM rq)")
               .replace("lower(product_name) AS kname", "strip_accents(lower(product_name)) AS kname"))


@register("new_product_check_collated", with_ctes(_ACCENT_SQL + """
SELECT seq, product_name, model_size, status, CAST(CASE WHEN NOT invalid THEN existing_id END AS DOUBLE) AS existing_id
FROM chk
""", "products", "sale_items"))
def q_new_product_check_collated(spark, sf_dir):
    """The duplicate probe under an accent-insensitive collation."""
    from pyspark.sql import functions as F
    from ..functions import exprs as X
    from ..operators import catalog
    out = catalog.new_product_check(tm.products(spark, sf_dir), tm.accented_requests(spark, sf_dir), X.ACCENT_INSENSITIVE)
    return for_compare(out.select("seq", "product_name", "model_size", "status", F.col("existing_id").cast("double").alias("existing_id")))


@register("add_products", with_ctes(_REQ_SQL + """,
firsts AS (SELECT kname, kmodel, MIN(seq) AS first_seq FROM chk WHERE status = 'new' GROUP BY 1, 2),
winners AS (SELECT c.* FROM chk c JOIN firsts f ON f.kname = c.kname AND f.kmodel = c.kmodel AND f.first_seq = c.seq)
SELECT CAST((SELECT MAX(id) FROM products) + row_number() OVER (ORDER BY seq) AS BIGINT) AS id,
       product_name, container_unit, container_quantity, pieces_per_container, model_size,
       CAST(CAST(unit_price AS DECIMAL(10,2)) AS DOUBLE) AS unit_price, CAST(0 AS BIGINT) AS loose_pieces
FROM winners
""", "products", "sale_items"))
def q_add_products(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..operators import catalog
    prods = tm.products(spark, sf_dir)
    after, _report = catalog.add_products(prods, tm.product_requests(spark, sf_dir))
    base = prods.agg(F.max("id")).first()[0]
    return for_compare(after.where(F.col("id") > base).select(
        "id", "product_name", "container_unit", "container_quantity", "pieces_per_container", "model_size",
        "unit_price", "loose_pieces"))


@register("restock", with_ctes(f""",
a AS (SELECT product_id, SUM(COALESCE(containers, 0)) AS dc, SUM(COALESCE(loose, 0)) AS dl, COUNT(*) AS requests
      FROM stock_events WHERE kind = 'add' GROUP BY product_id)
SELECT CAST(a.product_id AS BIGINT) AS product_id, a.requests,
       CAST(COALESCE(p.container_quantity, 0) + a.dc AS BIGINT) AS container_quantity,
       CAST(COALESCE(p.loose_pieces, 0) + a.dl AS BIGINT) AS loose_pieces,
       CAST((COALESCE(p.container_quantity, 0) + a.dc) * GREATEST(1, COALESCE(p.pieces_per_container, 0))
            + COALESCE(p.loose_pieces, 0) + a.dl AS BIGINT) AS total_pieces
FROM a JOIN products p ON p.id = a.product_id
""", "products", "stock_events"))
def q_restock(spark, sf_dir):
    from ..operators import catalog
    _after, report = catalog.restock(tm.products(spark, sf_dir), tm.stock_requests(spark, sf_dir, "add"))
    return for_compare(report)


# the products table after the requests, every row
@register("restock_products", with_ctes("""
SELECT CAST(p.id AS BIGINT) AS id, p.product_name,
       CAST(CASE WHEN a.product_id IS NULL THEN p.container_quantity
                 ELSE COALESCE(p.container_quantity, 0) + a.dc END AS BIGINT) AS container_quantity,
       CAST(CASE WHEN a.product_id IS NULL THEN p.loose_pieces
                 ELSE COALESCE(p.loose_pieces, 0) + a.dl END AS BIGINT) AS loose_pieces
FROM products p LEFT JOIN (SELECT product_id, SUM(COALESCE(containers, 0)) AS dc, SUM(COALESCE(loose, 0)) AS dl
                           FROM stock_events WHERE kind = 'add' GROUP BY product_id) a ON a.product_id = p.id
""", "products", "stock_events"))
def q_restock_products(spark, sf_dir):
    from ..operators import catalog
    after, _report = catalog.restock(tm.products(spark, sf_dir), tm.stock_requests(spark, sf_dir, "add"))
    return for_compare(after.select("id", "product_name", "container_quantity", "loose_pieces"))


@register("set_stock_products", with_ctes("""
SELECT CAST(p.id AS BIGINT) AS id, p.product_name,
       CAST(CASE WHEN s.product_id IS NULL THEN p.container_quantity ELSE s.c END AS BIGINT) AS container_quantity,
       CAST(CASE WHEN s.product_id IS NULL THEN p.loose_pieces ELSE s.l END AS BIGINT) AS loose_pieces
FROM products p LEFT JOIN (SELECT product_id, arg_max(COALESCE(containers, 0), event_id) AS c,
                                  arg_max(COALESCE(loose, 0), event_id) AS l
                           FROM stock_events WHERE kind = 'set' GROUP BY product_id) s ON s.product_id = p.id
""", "products", "stock_events"))
def q_set_stock_products(spark, sf_dir):
    from ..operators import catalog
    after, _report = catalog.set_stock(tm.products(spark, sf_dir), tm.stock_requests(spark, sf_dir, "set"))
    return for_compare(after.select("id", "product_name", "container_quantity", "loose_pieces"))


# Oracle: each product's requests one by one, as a recursive walk; a request
# that would leave the INT range changes nothing.
_RESTOCK_WALK = f""",
p AS (SELECT id, product_name, {PPC} AS ppc, CAST(COALESCE(container_quantity, 0) AS BIGINT) AS c0,
             CAST(COALESCE(loose_pieces, 0) AS BIGINT) AS l0 FROM products),
rq AS (SELECT e.event_id AS seq, e.product_id, CAST(COALESCE((CAST(e.containers AS BIGINT) - 1) * 900000000, 0) AS BIGINT) AS dc,
              CAST(COALESCE((CAST(e.loose AS BIGINT) - 2) * 800000000, 0) AS BIGINT) AS dl,
              row_number() OVER (PARTITION BY e.product_id ORDER BY e.event_id) AS k
       FROM stock_events e WHERE e.kind = 'add'),
walk AS (
  SELECT id AS product_id, CAST(0 AS BIGINT) AS k, c0 AS c, l0 AS l, CAST(0 AS BIGINT) AS dc, CAST(0 AS BIGINT) AS dl,
         CAST(NULL AS VARCHAR) AS refused
  FROM p
  UNION ALL
  SELECT product_id, k, CASE WHEN refused IS NULL THEN c + dc ELSE c END,
         CASE WHEN refused IS NULL THEN l + dl ELSE l END, dc, dl, refused
  FROM (SELECT rq.product_id, rq.k, w.c, w.l, rq.dc, rq.dl,
               CASE WHEN w.c + rq.dc NOT BETWEEN -2147483648 AND 2147483647 THEN 'container_quantity'
                    WHEN w.l + rq.dl NOT BETWEEN -2147483648 AND 2147483647 THEN 'loose_pieces' END AS refused
        FROM walk w JOIN rq ON rq.product_id = w.product_id AND rq.k = w.k + 1)
)
"""


@register("restock_requests", with_ctes(_RESTOCK_WALK + """
SELECT rq.seq, CAST(rq.product_id AS BIGINT) AS product_id,
       CASE WHEN p.id IS NULL THEN 'unknown' WHEN w.refused IS NULL THEN 'added' ELSE 'refused' END AS status,
       CASE WHEN p.id IS NULL THEN NULL
            WHEN w.refused IS NULL THEN 'Stock successfully added to existing product ''' || p.product_name || '''! Added: '
                 || w.dc || ' containers + ' || w.dl || ' pieces. New total: ' || (w.c * p.ppc + w.l) || ' pieces.'
            ELSE 'Failed to merge stock: SQLSTATE[22003]: Numeric value out of range: 1264 Out of range value for column '''
                 || w.refused || ''' at row 1' END AS message,
       CAST(w.c AS DOUBLE) AS container_quantity, CAST(w.l AS DOUBLE) AS loose_pieces,
       CAST(w.c * p.ppc + w.l AS DOUBLE) AS total_pieces
FROM rq LEFT JOIN p ON p.id = rq.product_id LEFT JOIN walk w ON w.product_id = rq.product_id AND w.k = rq.k
""", "products", "stock_events", recursive=True))
def q_restock_requests(spark, sf_dir):
    """The answer to each of the bulk requests; stock columns are missing for
    unknown products, so both sides emit them as DOUBLE."""
    from ..operators import catalog
    return for_compare(_stock_as_double(catalog.restock_requests(tm.products(spark, sf_dir), tm.bulk_requests(spark, sf_dir))))


def _stock_as_double(df):
    from pyspark.sql import functions as F
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("container_quantity", "loose_pieces", "total_pieces")
                       else F.col(c) for c in df.columns])


@register("bulk_restock_products", with_ctes(_RESTOCK_WALK + """
SELECT CAST(p.id AS BIGINT) AS id, p.product_name,
       CAST(CASE WHEN n.accepted > 0 THEN n.c ELSE q.container_quantity END AS BIGINT) AS container_quantity,
       CAST(CASE WHEN n.accepted > 0 THEN n.l ELSE COALESCE(q.loose_pieces, 0) END AS BIGINT) AS loose_pieces
FROM products q JOIN p ON p.id = q.id
JOIN (SELECT product_id, arg_max(c, k) AS c, arg_max(l, k) AS l,
             COUNT(*) FILTER (WHERE k > 0 AND refused IS NULL) AS accepted FROM walk GROUP BY product_id) n
  ON n.product_id = p.id
""", "products", "stock_events", recursive=True))
def q_bulk_restock_products(spark, sf_dir):
    """The products table after the bulk requests (missing loose pieces as 0)."""
    from pyspark.sql import functions as F
    from ..operators import catalog
    after, _report = catalog.restock(tm.products(spark, sf_dir), tm.bulk_requests(spark, sf_dir))
    return for_compare(after.select("id", "product_name", "container_quantity",
                                    F.coalesce("loose_pieces", F.lit(0)).alias("loose_pieces")))


@register("quick_add_requests", with_ctes(f""",
p AS (SELECT id, product_name, {PPC} AS ppc, COALESCE(container_quantity, 0) AS c0, COALESCE(loose_pieces, 0) AS l0
      FROM products),
rq AS (SELECT event_id AS seq, product_id, COALESCE(containers, 0) AS dc, COALESCE(loose, 0) AS dl
       FROM stock_events WHERE kind = 'add'),
r AS (SELECT rq.*, dc = 0 AND dl = 0 AS nothing, p.id, p.product_name, p.ppc,
             p.c0 + SUM(dc) OVER w AS c, p.l0 + SUM(dl) OVER w AS l
      FROM rq LEFT JOIN p ON p.id = rq.product_id
      WINDOW w AS (PARTITION BY rq.product_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CAST(product_id AS BIGINT) AS product_id,
       CASE WHEN nothing THEN 'nothing' WHEN id IS NULL THEN 'unknown' ELSE 'added' END AS status,
       CASE WHEN nothing THEN 'Please enter at least some containers or loose pieces to add.'
            WHEN id IS NOT NULL THEN 'Stock successfully added to existing product ''' || product_name || '''! Added: '
                 || dc || ' containers + ' || dl || ' pieces. New total: ' || CAST(c * ppc + l AS BIGINT) || ' pieces.' END
         AS message,
       CAST(CASE WHEN NOT nothing THEN c END AS DOUBLE) AS container_quantity,
       CAST(CASE WHEN NOT nothing THEN l END AS DOUBLE) AS loose_pieces,
       CAST(CASE WHEN NOT nothing THEN c * ppc + l END AS DOUBLE) AS total_pieces
FROM r
""", "products", "stock_events"))
def q_quick_add_requests(spark, sf_dir):
    """The restock requests sent by the quick-add form, which holds back those
    that add nothing."""
    from ..operators import catalog
    return for_compare(_stock_as_double(catalog.restock_requests(
        tm.products(spark, sf_dir), tm.stock_requests(spark, sf_dir, "add"), quick_add=True)))


@register("set_stock", with_ctes(""",
s AS (SELECT product_id, arg_max(COALESCE(containers, 0), event_id) AS c, arg_max(COALESCE(loose, 0), event_id) AS l,
             COUNT(*) AS requests
      FROM stock_events WHERE kind = 'set' GROUP BY product_id)
SELECT CAST(product_id AS BIGINT) AS product_id, requests, CAST(c AS BIGINT) AS container_quantity,
       CAST(l AS BIGINT) AS loose_pieces
FROM s WHERE product_id IN (SELECT id FROM products)
""", "products", "stock_events"))
def q_set_stock(spark, sf_dir):
    from ..operators import catalog
    _after, report = catalog.set_stock(tm.products(spark, sf_dir), tm.stock_requests(spark, sf_dir, "set"))
    return for_compare(report)


@register("update_prices", with_ctes(""",
c AS (SELECT id AS seq, product_id, CASE WHEN quantity_sold % 7 = 0 THEN 0 ELSE CAST(unit_price AS DOUBLE) END AS price
      FROM sale_items),
last AS (SELECT product_id, arg_max(price, seq) AS price FROM c WHERE price > 0 GROUP BY product_id)
SELECT CAST(p.id AS BIGINT) AS id, p.product_name,
       CAST(COALESCE(CAST(last.price AS DECIMAL(10,2)), p.unit_price) AS DOUBLE) AS unit_price,
       last.product_id IS NOT NULL AS changed
FROM products p LEFT JOIN last ON last.product_id = p.id
""", "products", "sale_items"))
def q_update_prices(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..operators import catalog
    prods = tm.products(spark, sf_dir)
    after, _report = catalog.update_prices(prods, tm.price_requests(spark, sf_dir))
    return for_compare(after.select("id", "product_name", "unit_price",
                                    F.col("updated_at").isNotNull().alias("changed")))


# --- table quality -----------------------------------------------------------
@register("conform_schema", with_ctes(f"""
SELECT CAST(id AS BIGINT) AS id, product_name, container_unit, CAST(container_quantity AS BIGINT) AS container_quantity,
       CAST(pieces_per_container AS BIGINT) AS pieces_per_container, individual_unit, model_size, description,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(minimum_stock AS BIGINT) AS minimum_stock, supplier_name,
       supplier_contact, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS updated_at,
       CAST(0 AS BIGINT) AS loose_pieces
FROM products
""", "products"))
def q_conform_schema(spark, sf_dir):
    """Products as an older schema without loose_pieces, brought to the
    declared schema (the column is added with its default 0)."""
    from ..operators.quality import conform_schema
    from ..sources.schema import PRODUCTS
    old = tm.products(spark, sf_dir).drop("loose_pieces")
    return for_compare(conform_schema(old, PRODUCTS))


@register("schema_report")
def q_schema_report(spark, sf_dir):
    from ..operators.quality import schema_report
    return for_compare(schema_report(spark, tm.load_all(spark, sf_dir)))


def _integrity_sql() -> str:
    from ..operators.quality import integrity_rules
    parents = {"sale_id": "sales", "product_id": "products"}
    parts = []
    for t, rule, c in integrity_rules():
        if rule == "not_null":
            q = f"SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM {t}"
        elif rule.startswith("max_length_"):
            q = f"SELECT COUNT(*) FILTER (WHERE length({c}) > {rule.rsplit('_', 1)[1]}) FROM {t}"
        elif rule in ("primary_key", "unique"):
            q = (f"SELECT COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL "
                 f"GROUP BY {c} HAVING COUNT(*) > 1)")
        else:
            q = f"SELECT COUNT(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {parents[c]})"
        parts.append(f"SELECT '{t}' AS \"table\", '{rule}' AS rule, '{c}' AS \"column\", "
                     f"CAST(({q}) AS BIGINT) AS violations")
    return with_ctes("\nUNION ALL\n".join(parts), "products", "sales", "sale_items")


@register("integrity_report", _integrity_sql())
def q_integrity_report(spark, sf_dir):
    from ..operators.quality import integrity_report
    t = tm.load_all(spark, sf_dir)
    return for_compare(integrity_report(t["products"], t["sales"], t["sale_items"]))


# --- helpers, cascade delete, preview totals ---------------------------------
@register("stock_helpers", with_ctes("""
SELECT CAST(id AS BIGINT) AS id,
       CAST(container_quantity AS BIGINT) * pieces_per_container AS calc_total_pieces,
       CASE WHEN pieces_per_container = 1
              THEN CAST(COALESCE(container_quantity, 0) AS VARCHAR) || ' ' ||
                   CASE WHEN COALESCE(container_quantity, 0) = 1 THEN 'piece' ELSE 'pieces' END
            WHEN pieces_per_container IS NULL OR pieces_per_container = 0 THEN NULL
            ELSE CAST(COALESCE(container_quantity, 0) AS VARCHAR) || ' ' ||
                 CASE WHEN COALESCE(container_quantity, 0) = 1 THEN 'container' ELSE 'containers' END
       END AS stock_display
FROM products
""", "products"))
def q_stock_helpers(spark, sf_dir):
    from pyspark.sql import functions as F
    from ..functions import exprs as X
    p = tm.products(spark, sf_dir)
    return for_compare(p.select(F.col("id"), X.calc_total_pieces().alias("calc_total_pieces"),
                                X.format_stock_display().alias("stock_display")))


@register("delete_cascade", with_ctes(f"""
SELECT (SELECT COUNT(*) FROM products WHERE product_name NOT ILIKE '%{PRODUCT_TERM}%') AS products_left,
       (SELECT COUNT(*) FROM sales WHERE CAST(sale_date AS DATE) NOT BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}')
         AS sales_left,
       (SELECT COUNT(*) FROM sale_items si
         WHERE si.product_id IN (SELECT id FROM products WHERE product_name NOT ILIKE '%{PRODUCT_TERM}%')
           AND si.sale_id IN (SELECT id FROM sales
                              WHERE CAST(sale_date AS DATE) NOT BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'))
         AS items_left
""", "products", "sales", "sale_items"))
def q_delete_cascade(spark, sf_dir):
    """Delete the products matching the product term and the sales of the
    date range; their sale lines go with them (ON DELETE CASCADE)."""
    from pyspark.sql import functions as F
    from ..functions import exprs as X
    from ..sources.tables import delete_cascade
    t = _t(spark, sf_dir)
    gone_p = t["products"].where(X.contains_ci("product_name", PRODUCT_TERM)).select("id")
    gone_s = t["sales"].where(X.date_between("sale_date", DATE_FROM, DATE_TO)).select("id")
    p, s, i = delete_cascade(t["products"], t["sales"], t["sale_items"], gone_p, gone_s)
    cnt = [df.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1))
           for df, n in ((p, "products_left"), (s, "sales_left"), (i, "items_left"))]
    return for_compare(cnt[0].join(cnt[1], "_k").join(cnt[2], "_k").drop("_k"))


@register("cart_preview_totals", with_ctes(_LINES_SQL + f""",
pp AS (SELECT id, {PPC} AS ppc, {TOTAL} AS stock, unit_price FROM products),
l2 AS (SELECT l.*, pp.ppc, pp.stock, pp.unit_price,
              regexp_matches(l.unit_type, 'box|container|sack|bundle') AS cont,
              CASE WHEN regexp_matches(l.unit_type, 'box|container|sack|bundle') THEN l.quantity * pp.ppc
                   ELSE l.quantity END AS need,
              row_number() OVER (PARTITION BY l.cart_id, l.product_id ORDER BY l.line_pos) AS k
       FROM l JOIN pp ON pp.id = l.product_id),
walk AS (
  SELECT cart_id, product_id, k, line_pos, (need <= stock) AS ok,
         CASE WHEN need <= stock THEN need ELSE 0 END AS used
  FROM l2 WHERE k = 1
  UNION ALL
  SELECT l2.cart_id, l2.product_id, l2.k, l2.line_pos, (w.used + l2.need <= l2.stock),
         w.used + CASE WHEN w.used + l2.need <= l2.stock THEN l2.need ELSE 0 END
  FROM walk w JOIN l2 ON l2.cart_id = w.cart_id AND l2.product_id = w.product_id AND l2.k = w.k + 1)
SELECT l2.cart_id, COUNT(*) FILTER (WHERE w.ok) AS lines,
       CAST(COALESCE(SUM(CASE WHEN w.ok THEN (CASE WHEN l2.cont THEN l2.unit_price * l2.ppc ELSE l2.unit_price END)
                              * l2.quantity END), 0) AS DOUBLE) AS total
FROM l2 JOIN walk w ON w.cart_id = l2.cart_id AND w.line_pos = l2.line_pos
GROUP BY l2.cart_id
""", "products", "sale_items", recursive=True))
def q_cart_preview_totals(spark, sf_dir):
    from ..operators import checkout as co
    return for_compare(co.cart_preview_totals(co.cart_preview(tm.carts(spark, sf_dir), tm.products(spark, sf_dir))))
