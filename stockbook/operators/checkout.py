"""Point-of-sale checkout of whole batches of carts.

``parse_carts`` (cart payload -> lines), ``cart_preview`` (the browser's
running cart: container units multiply pieces and price, a line that would
exceed the stock together with earlier lines of the product is refused) and
``checkout`` (the server: each cart in request order is all-or-nothing
against the stock left by the carts before it).

Checkout rules, per cart, lines in posted order, first failure wins:
1. payload not a non-empty JSON array/object -> "No items provided.";
2. (int)product_id <= 0 or (int)quantity <= 0 -> "Invalid item entry.";
3. product unknown -> "Product not found.";
4. quantity > pieces available at the start of the cart ->
   "<name> has only <n> available."; then a unit that is an array or object
   fails the server's trim. The check uses the *quantity*, lines of
   one cart are not summed, and the deduction is quantity * ppc for a
   container unit (box / container / sack / bundle, any letter case), clamped
   at 0 and stored normalised. The price is the product's, the line total
   is price * quantity (also for container units).
Accepted carts become a sale header (id and sale number assigned in request
order), sale items (ids in request order) and a new stock pair per product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..plans.lineage import reuse, written
from ..plans.scan import order_position, running_agg, scan_plan
from ..sources.schema import CART_ITEM
from .admission import greedy_admission
from .sales import in_days

# The messages of the checkout page.
NO_ITEMS = "No items provided."
INVALID_ITEM = "Invalid item entry."
NOT_FOUND = "Product not found."
# The server's error for a unit that is no text.
UNIT_NESTED = "trim(): Argument #1 ($string) must be of type string, array given"
# The database's error for a value outside a column's range (MySQL error 1264).
OUT_OF_RANGE = "SQLSTATE[22003]: Numeric value out of range: 1264 Out of range value for column '{}' at row 1"
MONEY_MAX = "99999999.99"
# Browser-side refusals of the cart form.
SELECT_PRODUCT = "Please select a product"
VALID_QUANTITY = "Please enter a valid quantity"
NOT_ENOUGH = "Not enough stock."


# A payload in which the type of a value matters: booleans or nested values
# (also where such text stands inside a string, which the typed reading tells).
_NESTED = r":\s*[\[{]"

# What ``_typed_line`` gives.
_TYPED_LINES = ("array<struct<product_id:string,quantity:string,unit_type:string,unit_price:string,"
                "product_number:bigint,quantity_number:bigint,unit_nested:boolean>>")

# What checkout reads of a cart, besides its id and time.
_POSTED = ("items", "staff_name", "customer_name", "customer_address", "lpo_number")


def _typed_number(v: F.Column) -> F.Column:
    """(int) of a JSON value that is not a number or text: a boolean as 1 or 0,
    an array or object as 1 unless it is empty. NULL for numbers, text, null."""
    kind = F.schema_of_variant(v)
    nested = F.to_json(v)
    return (F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"),
                  F.when(nested.isin("[]", "{}"), 0).otherwise(1).cast("bigint")))


def _typed_line(x: F.Column) -> F.Column:
    """A line of a typed payload."""
    part = lambda name, kind: F.try_variant_get(x, f"$.{name}", kind)
    unit = part("unit_type", "variant")
    kind = F.schema_of_variant(unit)
    flag = F.try_variant_get(unit, "$", "boolean")
    text = F.when(kind == "BOOLEAN", F.when(flag, "1").otherwise("")).otherwise(part("unit_type", "string"))
    return F.struct(part("product_id", "string").alias("product_id"), part("quantity", "string").alias("quantity"),
                    text.alias("unit_type"), part("unit_price", "string").alias("unit_price"),
                    _typed_number(part("product_id", "variant")).alias("product_number"),
                    _typed_number(part("quantity", "variant")).alias("quantity_number"),
                    F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False)).alias("unit_nested"))


def parse_payloads(carts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per posted element, plus one row with NULL ``line_pos`` for a
    cart whose payload is not a non-empty JSON array or object.

    The payload is parsed once: directly as an array of line objects; an
    object payload through its values; an array holding non-objects (the
    direct parse gives NULL) element by element, so such elements become
    all-NULL lines ("Invalid item entry.") like the server reads them. Fields
    are read after the explode, so no element is parsed twice.

    Payloads with booleans or nested values are read as VARIANT, which keeps
    the JSON types: ``true`` is the number 1 where the text "true" is 0, an array
    or object is 1 unless it is empty, a boolean unit is "1" or "". A nested unit
    fails the server's trim; ``unit_nested`` marks it.
    """
    raw = F.col("_raw")
    per_elem = lambda arr: F.transform(arr, lambda x: F.from_json(x, CART_ITEM))
    as_object = per_elem(F.map_values(F.from_json(raw, T.MapType(T.StringType(), T.StringType()))))
    as_array = F.coalesce(F.from_json(raw, T.ArrayType(CART_ITEM)),
                          per_elem(F.from_json(raw, T.ArrayType(T.StringType()))))
    typed_object = F.map_values(F.from_json(raw, T.MapType(T.StringType(), T.VariantType())))
    typed_array = F.from_json(raw, T.ArrayType(T.VariantType()))
    is_object = raw.startswith("{")
    # columns of their own, so that the payload is trimmed and looked through once
    read = (carts.select("cart_id", *keep, X.php_trim("items").alias("_raw"))
            .select("*", (raw.contains("true") | raw.contains("false") | raw.rlike(_NESTED)).alias("_typed")))
    typed = F.col("_typed")
    is_plain = F.when(~typed, F.when(is_object, as_object).otherwise(as_array))
    is_typed = F.when(typed, F.transform(F.when(is_object, typed_object).otherwise(typed_array), _typed_line))
    # one of the two is empty; zipped, no plain line is copied
    elems = F.arrays_zip(F.coalesce(is_plain, F.array().cast(T.ArrayType(CART_ITEM))).alias("plain"),
                         F.coalesce(is_typed, F.array().cast(_TYPED_LINES)).alias("typed"))
    ex = read.select("cart_id", *keep, F.posexplode_outer(elems).alias("_pos", "_it"))
    plain, typed_line = F.col("_it.plain"), F.col("_it.typed")
    field = lambda c: F.coalesce(typed_line[c], plain[c])
    return ex.select(
        "cart_id", *keep,
        (F.col("_pos") + 1).cast("int").alias("line_pos"),
        F.coalesce(typed_line["product_number"], X.php_int(field("product_id"))).alias("product_id"),
        F.coalesce(typed_line["quantity_number"], X.php_int(field("quantity"))).alias("quantity"),
        X.php_trim(F.coalesce(field("unit_type"), F.lit("pieces"))).alias("unit_type"),
        X.php_number(field("unit_price")).alias("client_unit_price"),
        field("product_id").alias("product_id_text"),
        field("quantity").alias("quantity_text"),
        F.coalesce(typed_line["unit_nested"], F.lit(False)).alias("unit_nested"),
    ).withColumn("line_ok", (F.col("product_id") > 0) & (F.col("quantity") > 0))


def split_payloads(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, empty carts with their reason) from ``parse_payloads``."""
    lines = parsed.where(F.col("line_pos").isNotNull())
    empty = parsed.where(F.col("line_pos").isNull()).select("cart_id", F.lit(NO_ITEMS).alias("reason"))
    return lines, empty


def parse_carts(carts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split cart payloads into lines.

    Returns ``(lines, empty)``: ``lines`` has one row per posted element
    (cart_id, line_pos from 1, product_id, quantity, unit_type,
    client_unit_price, raw text fields, line_ok); ``empty`` lists the carts
    whose payload is not a non-empty array or object.
    """
    return split_payloads(parse_payloads(carts))


def _product_side(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").cast("bigint").alias("_pid"), "product_name", "unit_price",
                           X.eff_ppc().alias("ppc"), X.total_pieces().alias("stock"))


# ---------------------------------------------------------------------------
# Browser preview
# ---------------------------------------------------------------------------
def js_parse_int(c) -> F.Column:
    """parseInt(text, 10): leading integer digits, NULL when none."""
    m = F.regexp_extract(c, r"^[ \t\n\r\x0B\f]*([+-]?[0-9]+)", 1)
    return F.when(m == "", F.lit(None).cast("bigint")).otherwise(m.try_cast("bigint"))


def cart_preview(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Each posted line replayed through the browser's "add item" button.

    A line is refused if its product is not in the picker, its quantity is
    not >= 1 (parseInt), or the pieces it needs plus those of the accepted
    earlier lines of the same product in the cart exceed the stock shown.
    Container units (case-sensitive test) need qty * ppc pieces and show the
    price * ppc. Returns one row per line with ``accepted``, ``reason``,
    ``pieces_needed``, ``display_price``, ``line_total``.

    All lines of a cart come from one payload, so the lines of a (cart,
    product) are few: they are gathered in order and folded once.
    """
    one = carts.withColumn("_cart", F.monotonically_increasing_id())   # a cart_id may be posted twice
    lines, _empty = split_payloads(parse_payloads(one, keep=("_cart",)))
    qty = js_parse_int(F.col("quantity_text"))
    pid = js_parse_int(F.col("product_id_text"))
    unit = F.when(F.col("unit_type") == "", F.lit("pieces")).otherwise(F.col("unit_type"))
    p = _product_side(products)
    l = (lines.select("_cart", "cart_id", "line_pos", pid.alias("product_id"), qty.alias("quantity"),
                      unit.alias("unit_type"))
         .join(p, F.col("product_id") == p["_pid"], "left"))
    cont = X.is_container_unit("unit_type", case_sensitive=True)
    line = F.struct(
        "line_pos", "cart_id", "quantity", "unit_type", "stock",
        F.when(F.col("_pid").isNull(), F.lit(SELECT_PRODUCT))
         .when(F.col("quantity").isNull() | (F.col("quantity") < 1), F.lit(VALID_QUANTITY)).alias("static"),
        # a need beyond bigint is certainly refused, like the largest one
        F.when(cont, F.coalesce((F.col("quantity").cast("decimal(20,0)") * F.col("ppc").cast("decimal(18,0)"))
                                .try_cast("bigint"), F.lit((1 << 62) - 1)))
         .otherwise(F.col("quantity")).alias("need"),
        F.when(cont, F.col("unit_price") * F.col("ppc").cast("decimal(20,0)"))
         .otherwise(F.col("unit_price")).alias("price"))
    groups = (l.select("_cart", "product_id", line.alias("line")).groupBy("_cart", "product_id")
              .agg(F.sort_array(F.collect_list("line")).alias("lines")))

    def add(state, x):
        left = x["stock"] - state["used"]
        fits = x["static"].isNull() & (x["need"] <= left)
        return F.struct(F.when(fits, state["used"] + x["need"]).otherwise(state["used"]).alias("used"),
                        F.concat(state["out"], F.array(F.struct(fits.alias("ok"), left.alias("left")))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"),
                     F.array().cast("array<struct<ok:boolean,left:bigint>>").alias("out"))
    verdicts = F.aggregate("lines", start, add, lambda s: s["out"])
    x = F.col("e.lines")
    ok = F.coalesce(F.col("e.v.ok"), F.lit(False))
    refusal = F.concat(F.lit(NOT_ENOUGH + " Need "), x["need"].cast("string"), F.lit(" pieces, but only "),
                       F.col("e.v.left").cast("string"), F.lit(" available."))
    return (groups.withColumn("v", verdicts).select("product_id", F.explode(F.arrays_zip("lines", "v")).alias("e"))
            .select(x["cart_id"].alias("cart_id"), x["line_pos"].alias("line_pos"), "product_id",
                    x["quantity"].alias("quantity"), x["unit_type"].alias("unit_type"),
                    x["need"].alias("pieces_needed"), x["price"].alias("display_price"), ok.alias("accepted"),
                    F.coalesce(x["static"], F.when(~ok, refusal)).alias("reason"),
                    F.when(ok, x["price"] * x["quantity"].cast("decimal(20,0)")).alias("line_total")))


def cart_preview_totals(preview: DataFrame) -> DataFrame:
    """Receipt preview total per cart: sum of the accepted line totals."""
    return preview.groupBy("cart_id").agg(
        F.count_if("accepted").alias("lines"),
        F.coalesce(F.sum("line_total"), F.lit(0).cast("decimal(38,2)")).alias("total"))


# ---------------------------------------------------------------------------
# Server checkout
# ---------------------------------------------------------------------------
@dataclass
class CheckoutResult:
    decisions: DataFrame   # one row per posted cart: cart_id, accepted, reason, sale_id, sale_number,
                           # total_amount, rounds (admission passes; 0 for carts refused by a line
                           # of their own, whatever was sold before)
    sales: DataFrame       # new sale headers
    sale_items: DataFrame  # new sale lines
    stock: DataFrame       # product_id, container_quantity, loose_pieces, updated_at (changed products)
    products: DataFrame    # the products table after checkout
    last_sale_id: int = 0  # largest sale id after this batch
    last_item_id: int = 0  # largest sale item id after this batch


def _pieces(container) -> F.Column:
    """Pieces a line takes from the stock. A line asking for more than the
    stock is refused whatever was sold before it and takes nothing; the stock
    never falls below 0, so a line takes at most the stock. Both keep sums far
    from overflow; the product is computed as a decimal."""
    asked = F.col("quantity").cast("decimal(20,0)") * F.when(container, F.col("ppc")).otherwise(1).cast("decimal(18,0)")
    stock = F.col("stock").cast("decimal(38,0)")
    return (F.when(F.col("quantity") > F.col("stock"), 0)
            .otherwise(F.greatest(F.lit(0), F.least(asked, stock))).cast("bigint"))


def _max_id(df: DataFrame | None, c: str) -> int:
    """Largest id so far (0 when none): one number read on the driver."""
    if df is None:
        return 0
    v = df.agg(F.max(c).cast("bigint")).first()[0]
    return int(v or 0)


def checkout(carts: DataFrame, products: DataFrame, sales: DataFrame | None = None,
             sale_items: DataFrame | None = None, chunk_rows: int | None = None,
             id_base: tuple[int, int] | None = None) -> CheckoutResult:
    """Sell a batch of carts in (ts, cart_id) order against ``products``.

    ``sales`` / ``sale_items``, when given, are the existing tables: new ids
    continue after their largest id and sale numbers continue each day's
    numbering (only the existing sales of the batch's days are read, a
    pushed range on ``sale_date``). ``id_base`` = (largest sale id, largest
    item id) when the caller knows them (the table store keeps them), which
    saves scanning the id columns. Returns a :class:`CheckoutResult`;
    nothing is written.
    """
    if id_base is None:
        base_sale, base_item = _max_id(sales, "id"), _max_id(sale_items, "id")
    else:
        base_sale, base_item = int(id_base[0]), int(id_base[1])
    # a cart without a time is sold now; from here on ``cart_id`` is the number of
    # its row, since one cart_id may be posted twice, and ``seq`` its place in the
    # order. Only ids and times are sorted, the payloads stay where they are
    posted = written(carts.select(
        F.col("cart_id").alias("_posted_id"),
        F.coalesce("ts", F.current_timestamp().cast(carts.schema["ts"].dataType)).alias("ts"),
        *[F.col(c).cast("string").alias(c) for c in _POSTED], F.monotonically_increasing_id().alias("cart_id")), "carts")
    order = written(order_position(posted.select("cart_id", "_posted_id", "ts"), ["ts", "_posted_id"], "seq",
                                   materialize=False), "order")
    parsed = parse_payloads(posted)
    p = _product_side(products)
    cont = X.is_container_unit("unit_type")
    l = parsed.join(p, F.col("product_id") == p["_pid"], "left").select(
        "cart_id", "line_pos", "product_id", "quantity", "unit_type", "unit_price", "ppc", "stock",
        F.col("product_name").isNotNull().alias("_named"),
        F.when(~F.col("line_ok"), F.lit(INVALID_ITEM))
         .when(F.col("_pid").isNull(), F.lit(NOT_FOUND)).alias("_static"),
        F.when(F.col("unit_nested"), F.lit(UNIT_NESTED)).alias("_unit_error"),
        _pieces(cont).alias("pieces"))
    # a line with an error of its own, or asking for more than the whole stock,
    # refuses its cart whatever was sold before: the cart takes no part in the
    # admission, and its lines after the first such line can't be its reason
    stopped = F.col("_static").isNotNull() | F.col("_unit_error").isNotNull()
    beyond = F.coalesce(F.col("quantity") > F.col("stock"), F.lit(False))
    cart = Window.partitionBy("cart_id")
    l = (l.withColumn("_fails", F.max(stopped | beyond).over(cart))
         .withColumn("_stop", F.min(F.when(stopped | (beyond & F.col("_named")), F.col("line_pos"))).over(cart)))
    l = l.where(F.col("line_pos").isNull() | F.col("_stop").isNull() | (F.col("line_pos") <= F.col("_stop")))
    # read by the skew check, the admission, the reasons and the accepted lines
    l = reuse(l.join(order.select("cart_id", "seq"), "cart_id"))
    l, empty = split_payloads(l)
    able = l.where(~F.col("_fails"))
    # a header or line amount beyond DECIMAL(10,2) fails its INSERT, which
    # rolls the cart back after all its lines passed the checks
    line_total = F.col("unit_price") * F.col("quantity").cast("decimal(20,0)")
    amounts = able.groupBy("cart_id").agg(F.sum(line_total).alias("_sum"), F.max(line_total).alias("_max_line"))
    too_big = amounts.select(
        "cart_id",
        F.when(F.col("_sum") > F.lit(MONEY_MAX).cast("decimal(10,2)"), F.lit(OUT_OF_RANGE.format("total_amount")))
         .when(F.col("_max_line") > F.lit(MONEY_MAX).cast("decimal(10,2)"), F.lit(OUT_OF_RANGE.format("total_price")))
         .alias("_insert_error")).where(F.col("_insert_error").isNotNull())
    usage = reuse(able.join(too_big, "cart_id", "left_anti")
                  .groupBy("cart_id", "product_id")
                  .agg(F.first("seq").alias("seq"), F.max("quantity").alias("need"),
                       F.sum("pieces").alias("take"), F.first("stock").alias("cap")))
    # one skew check for both scans over products (no scan has more rows of one)
    counted = l.where(F.col("_static").isNull())
    n = chunk_rows if chunk_rows else scan_plan(counted, ["product_id"])
    adm = greedy_admission(usage, ["cart_id"], ["product_id"], "seq", chunk_rows=n or None,
                           one_level=not n)
    acc = reuse(adm.where("admitted").select("cart_id"))

    # exact stock at the start of each refused cart, for the message: what
    # the accepted carts before it took
    asked = (counted.join(acc, "cart_id", "left_anti")
             .select("product_id", "seq", F.lit(0).cast("bigint").alias("take"), F.lit(0).alias("_one"), "cart_id", "line_pos",
                     "quantity", "stock", "_named", "_unit_error"))
    taken = (usage.join(acc, "cart_id", "left_semi").select("product_id", "seq", "take", F.lit(1).alias("_one")))
    lv = running_agg(asked.unionByName(taken, allowMissingColumns=True), ["product_id"], "seq",
                     {"_taken": ("sum", "take"), "_n": ("sum", "_one")}, n, inclusive=False)
    left = F.when(F.col("_n") > 0, F.greatest(F.lit(0), F.col("stock") - F.col("_taken"))).otherwise(F.col("stock"))
    short = (F.col("quantity") > left) & F.col("_named")
    no_number = F.lit(None).cast("bigint")
    errors = lv.where(short | F.col("_unit_error").isNotNull()).select(
        "cart_id", "line_pos", F.when(~short, F.col("_unit_error")).alias("_text"),
        F.when(short, F.col("product_id")).alias("_short"), F.when(short, left).alias("_left"))
    other = lambda df, pos, text: df.select(
        "cart_id", pos.cast("int").alias("line_pos"), F.col(text).alias("_text"), no_number.alias("_short"),
        no_number.alias("_left"))
    # an error of the INSERT comes after those of all lines
    errors = (errors.union(other(l.where(F.col("_static").isNotNull()), F.col("line_pos"), "_static"))
              .union(other(empty, F.lit(0), "reason"))
              .union(other(too_big, F.lit((1 << 31) - 1), "_insert_error")))
    first = (errors.groupBy("cart_id").agg(F.min_by(F.struct("_text", "_short", "_left"), "line_pos").alias("_e"))
             .select("cart_id", "_e.*"))
    names = (products.groupBy(F.col("id").cast("bigint").alias("_short"))
             .agg(F.first("product_name", ignorenulls=True).alias("_name")))
    stock_msg = F.concat(F.col("_name"), F.lit(" has only "), F.col("_left").cast("string"), F.lit(" available."))
    reasons = first.join(names, "_short", "left").select("cart_id", F.coalesce("_text", stock_msg).alias("reason"))
    acc_lines = reuse(able.join(acc.join(order.select("cart_id", "ts"), "cart_id"), "cart_id").withColumn(
        "total_price", (F.col("unit_price") * F.col("quantity").cast("decimal(20,0)")).cast("decimal(10,2)")))

    # headers: ids and per-day numbers in request order
    heads = (acc_lines.groupBy("cart_id")
             .agg(F.first("seq").alias("seq"), F.first("ts").alias("ts"),
                  F.sum("total_price").cast("decimal(10,2)").alias("total_amount"),
                  F.count(F.lit(1)).alias("_nlines"))
             .withColumn("_one", F.lit(1)))
    heads = reuse(heads)
    heads = running_agg(heads, [], "seq", {"_before": ("sum", "_one"), "_lines_before": ("sum", "_nlines")},
                        chunk_rows if chunk_rows else scan_plan(heads, []), inclusive=False)
    heads = heads.withColumn("_day", F.to_date("ts"))
    day_first = heads.groupBy("_day").agg(F.min("_before").alias("_day_first"))
    counts = heads.agg(F.count(F.lit(1)).alias("n"), F.sum("_nlines").alias("lines"),
                       F.min("_day").alias("lo"), F.max("_day").alias("hi")).first()
    if sales is not None and counts["n"]:
        days = in_days(sales, counts["lo"].isoformat(), counts["hi"].isoformat())
        nums = (days.where((F.length("sale_number") >= 20) & F.col("sale_number").startswith(X.SALE_PREFIX))
                .select(F.to_date(F.substring("sale_number", 5, 8), "yyyyMMdd").alias("_day"),
                        F.substring("sale_number", 13, 19).try_cast("bigint").alias("_n"))
                .groupBy("_day").agg(F.max("_n").alias("_day_used")))
        # written, so that publishing the batch to the same table can't change them
        nums = written(nums.join(day_first.select("_day"), "_day", "left_semi"), "numbers")
    else:
        nums = day_first.select("_day", F.lit(0).cast("bigint").alias("_day_used")).where(F.lit(False))
    heads = heads.join(day_first, "_day").join(nums, "_day", "left")
    heads = heads.select(
        "cart_id", "seq", "ts", "total_amount", "_lines_before",
        F.lit(base_item).cast("bigint").alias("_bi"),
        (F.lit(base_sale) + F.col("_before") + 1).cast("bigint").alias("sale_id"),
        X.sale_number("_day", F.coalesce(F.col("_day_used"), F.lit(0)) + F.col("_before") - F.col("_day_first") + 1)
        .alias("sale_number"))
    heads = reuse(heads)

    cinfo = posted.select("cart_id",
                         X.php_trim(F.coalesce("staff_name", F.lit(X.DEFAULT_STAFF))).alias("staff_name"),
                         X.php_trim(F.coalesce("customer_name", F.lit(""))).alias("customer_name"),
                         X.php_trim(F.coalesce("customer_address", F.lit(""))).alias("customer_address"),
                         X.php_trim(F.coalesce("lpo_number", F.lit(""))).alias("lpo_number"))
    new_sales = heads.join(cinfo, "cart_id").select(
        F.col("sale_id").alias("id"), "sale_number", "total_amount", F.col("ts").alias("sale_date"),
        "staff_name", "customer_name", "customer_address", "lpo_number",
        F.lit(None).cast("string").alias("notes"))
    new_items = acc_lines.join(heads.select("cart_id", "sale_id", "_lines_before", "_bi"), "cart_id").select(
        (F.col("_bi") + F.col("_lines_before") + F.col("line_pos")).cast("bigint").alias("id"),
        "sale_id", F.col("product_id").cast("int").alias("product_id"),
        F.col("quantity").cast("int").alias("quantity_sold"), "unit_type", "unit_price", "total_price")

    # stock: all accepted deductions of a product at once, clamped, normalised
    taken = (acc_lines.groupBy("product_id")
             .agg(F.sum("pieces").alias("_take"), F.first("stock").alias("_s0"), F.first("ppc").alias("_ppc"),
                  F.max("ts").alias("updated_at")))
    left_total = F.greatest(F.lit(0), F.col("_s0") - F.col("_take"))
    stock = taken.select(
        F.col("product_id").cast("int").alias("product_id"),
        ((left_total - left_total % F.col("_ppc")) / F.col("_ppc")).cast("int").alias("container_quantity"),
        (left_total % F.col("_ppc")).cast("int").alias("loose_pieces"),
        "updated_at")
    new_products = apply_stock(products, stock)

    decisions = (order.select("cart_id", "_posted_id")
                 .join(adm.select("cart_id", "admitted", "rounds"), "cart_id", "left")
                 .join(reasons, "cart_id", "left")
                 .join(heads.select("cart_id", "sale_id", "sale_number", "total_amount"), "cart_id", "left"))
    ok = F.coalesce(F.col("admitted"), F.lit(False))
    decisions = decisions.select(
        F.col("_posted_id").alias("cart_id"), ok.alias("accepted"), F.when(~ok, F.col("reason")).alias("reason"),
        "sale_id", "sale_number", "total_amount", F.coalesce("rounds", F.lit(0)).alias("rounds"))
    return CheckoutResult(decisions, new_sales, new_items, stock, new_products,
                          base_sale + int(counts["n"] or 0), base_item + int(counts["lines"] or 0))


def apply_stock(products: DataFrame, stock: DataFrame) -> DataFrame:
    """Products with the changed stock pairs replaced and ``updated_at``
    touched (a keyed update: left join + coalesce, one pass)."""
    s = stock.select(F.col("product_id").alias("_id"), F.col("container_quantity").alias("_c"),
                     F.col("loose_pieces").alias("_l"), F.col("updated_at").alias("_u"))
    j = products.join(s, products["id"] == s["_id"], "left")
    hit = F.col("_id").isNotNull()
    cols = []
    for name in products.columns:
        if name == "container_quantity":
            cols.append(F.when(hit, F.col("_c")).otherwise(F.col(name)).alias(name))
        elif name == "loose_pieces":
            cols.append(F.when(hit, F.col("_l")).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            cols.append(F.when(hit, F.col("_u").cast(products.schema[name].dataType))
                        .otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return j.select(*cols)
