"""Catalog and stock maintenance from batches of requests.

Each request carries an integer ``seq`` (request order). Form values are read
as the server reads them: text is trimmed, numbers are cast leniently. All
jobs are set-based: a keyed aggregate (``min``/``max_by`` by ``seq``, with
map-side combine, so a key with very many requests is not one task) followed
by a join on the key; no per-key window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.lineage import reuse
from ..plans.scan import running_agg, scan_plan
from .restocking import amount, in_int, in_order, totals

# Messages of the inventory page.
REQUIRED = "Product name and unit price are required."
PRICE_POSITIVE = "Price must be greater than 0."
# The database's error for a value outside a column's range (MySQL error 1264).
OUT_OF_RANGE = "SQLSTATE[22003]: Numeric value out of range: 1264 Out of range value for column '{}' at row 1"
MONEY_MAX = 99999999.99
INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1

NEW, DUPLICATE, INVALID = "new", "duplicate", "invalid"
# Answers of the stock forms.
NOTHING_TO_ADD = "Please enter at least some containers or loose pieces to add."
MERGE_FAILED = "Failed to merge stock: "
ADDED, REFUSED, UNKNOWN, NOTHING = "added", "refused", "unknown", "nothing"

_TEXT = ("product_name", "container_unit", "individual_unit", "model_size", "supplier_name",
         "supplier_contact", "description")
_INTS = ("container_quantity", "pieces_per_container", "minimum_stock")


def _form(c: str, cols: list[str]):
    """A posted text field: trim(value), a missing field reads as ''."""
    if c not in cols:
        return F.lit("")
    return X.php_trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def read_product_form(candidates: DataFrame, collation: str | None = None) -> DataFrame:
    """Candidates as the add-product handler reads them, plus the duplicate
    key (lower(name), lower(model ?: ''))."""
    cols = candidates.columns
    out = [F.col("seq")]
    out += [_form(c, cols).alias(c) for c in _TEXT]
    out += [(X.php_int(F.col(c)) if c in cols else F.lit(0).cast("bigint")).alias(c) for c in _INTS]
    out.append((X.php_number(F.col("unit_price")) if "unit_price" in cols else F.lit(0.0)).alias("unit_price"))
    f = candidates.select(*out)
    model_key = F.when(X.php_falsy_str("model_size"), F.lit("")).otherwise(F.col("model_size"))
    # a value outside its column's range fails the INSERT (after the checks)
    range_error = F.when(F.col("unit_price") > F.lit(MONEY_MAX), F.lit(OUT_OF_RANGE.format("unit_price")))
    for c in _INTS:
        range_error = range_error.when(~F.col(c).between(INT_MIN, INT_MAX), F.lit(OUT_OF_RANGE.format(c)))
    return (f.withColumn("_kname", X.collated("product_name", collation))
            .withColumn("_kmodel", X.collated(model_key, collation))
            .withColumn("_invalid", X.php_falsy_str("product_name") | (F.col("unit_price") <= 0))
            .withColumn("_range_error", range_error))


def _existing_by_key(products: DataFrame, collation: str | None = None) -> DataFrame:
    """One row per duplicate key of the catalog: the lowest id holding it."""
    p = products.select(
        X.collated("product_name", collation).alias("_kname"),
        X.collated(F.coalesce("model_size", F.lit("")), collation).alias("_kmodel"),
        F.struct(F.col("id").alias("existing_id"), F.col("product_name").alias("existing_name"),
                 X.php_fallback("model_size", X.NO_MODEL).alias("existing_model"),
                 X.total_pieces().alias("existing_total")).alias("_e"),
        F.col("id"))
    return p.groupBy("_kname", "_kmodel").agg(F.min_by("_e", "id").alias("_e"))


def _checked_forms(products: DataFrame, candidates: DataFrame, collation: str | None) -> DataFrame:
    """The read forms, their duplicate keys, the product they duplicate
    (``_e``, if any) and their ``status``."""
    f = read_product_form(candidates, collation)
    j = f.join(_existing_by_key(products, collation), ["_kname", "_kmodel"], "left")
    status = (F.when(F.col("_invalid"), F.lit(INVALID))
              .when(F.col("_e").isNotNull(), F.lit(DUPLICATE))
              .when(F.col("_range_error").isNotNull(), F.lit(INVALID)).otherwise(F.lit(NEW)))
    return j.withColumn("status", status)


def _check_report(checked: DataFrame) -> DataFrame:
    e = F.col("_e")
    return checked.select(
        "seq", "product_name", "model_size", "status",
        F.when(F.col("_invalid"), F.lit(REQUIRED))
         .when(e.isNull(), F.col("_range_error")).alias("message"),
        F.when(~F.col("_invalid"), e["existing_id"]).alias("existing_id"),
        F.when(~F.col("_invalid"), e["existing_total"]).alias("existing_total"),
        F.when(~F.col("_invalid") & e.isNotNull(),
               F.col("container_quantity") * F.col("pieces_per_container")).alias("adding_pieces"))


def new_product_check(products: DataFrame, candidates: DataFrame, collation: str | None = None) -> DataFrame:
    """Per candidate: ``invalid`` (name empty or price <= 0), ``duplicate``
    of an existing product (same name and model, letter case ignored, no
    model = ''), or ``new``. Duplicates report the existing product, its
    stock in pieces (with its stored pieces-per-container) and the pieces the
    request would add (containers * pieces per container, as submitted).
    ``collation``: names and models that it holds equal are equal."""
    return _check_report(_checked_forms(products, candidates, collation))


def add_products(products: DataFrame, candidates: DataFrame, now=None,
                 chunk_rows: int | None = None, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert the valid, non-duplicate candidates; within the batch the
    first request of a key wins and later ones are duplicates of it.

    Returns ``(products_after, report)``. New ids continue after the largest
    id in request order; ``loose_pieces`` takes its default 0 and the time
    stamps ``now`` (default: the current timestamp).

    The forms are read and probed once. The winners are numbered by one window
    while they are at most a chunk of ``plans.scan``, beyond that in chunks."""
    forms = reuse(_checked_forms(products, candidates, collation))
    checked = _check_report(forms)
    fresh = forms.where(F.col("status") == NEW)
    first = fresh.groupBy("_kname", "_kmodel").agg(F.min("seq").alias("_first"))
    fresh = fresh.join(first, ["_kname", "_kmodel"])
    winners = fresh.where(F.col("seq") == F.col("_first")).withColumn("_one", F.lit(1))
    n = chunk_rows if chunk_rows else scan_plan(winners, [])
    winners = running_agg(winners, [], "seq", {"_rank": ("sum", "_one")}, n, inclusive=True)
    base = products.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]
    ts = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    schema = products.schema
    new_rows = winners.select(
        (F.lit(int(base)) + F.col("_rank")).cast("int").alias("id"),
        *[F.col(c).alias(c) for c in ("product_name", "container_unit")],
        F.col("container_quantity").cast("int").alias("container_quantity"),
        F.col("pieces_per_container").cast("int").alias("pieces_per_container"),
        "individual_unit", "model_size", "description",
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
        F.col("minimum_stock").cast("int").alias("minimum_stock"),
        "supplier_name", "supplier_contact",
        ts.alias("created_at"), ts.alias("updated_at"),
        F.lit(0).cast("int").alias("loose_pieces"))
    new_rows = new_rows.select(*[F.col(c).cast(schema[c].dataType) for c in products.columns])
    after = products.unionByName(new_rows)
    dup_in_batch = fresh.where(F.col("seq") != F.col("_first")).select("seq", F.col("_first").alias("_dup_of"))
    report = (checked.join(dup_in_batch, "seq", "left")
              .join(winners.select("seq", (F.lit(int(base)) + F.col("_rank")).cast("int").alias("new_id")),
                    "seq", "left")
              .withColumn("status", F.when(F.col("_dup_of").isNotNull(), F.lit(DUPLICATE))
                          .otherwise(F.col("status")))
              .withColumnRenamed("_dup_of", "duplicate_of_seq"))
    return after, report


def _keyed_update(products: DataFrame, changes: DataFrame, columns: dict[str, str], now=None) -> DataFrame:
    """Replace ``columns`` (target -> change column) for the ids in
    ``changes`` (one row per id) and touch ``updated_at``."""
    ch = changes.withColumnRenamed("product_id", "_id")
    j = products.join(ch, products["id"] == ch["_id"], "left")
    hit = F.col("_id").isNotNull()
    ts = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    out = []
    for c in products.columns:
        dt = products.schema[c].dataType
        if c in columns:
            out.append(F.when(hit, F.col(columns[c]).cast(dt)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, ts.cast(dt)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def _js_zero(c: str) -> F.Column:
    """``value == 0`` of a form field in the browser: a blank field counts."""
    text = F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return (text == "") | F.coalesce(text.try_cast("double") == 0, F.lit(False))


def quick_add_guard(additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quick-add form refuses a request adding nothing (0 containers and
    0 loose pieces). Returns (requests to send, refused requests)."""
    nothing = _js_zero("containers") & _js_zero("loose")
    return additions.where(~nothing), additions.where(nothing)


def _additions(products: DataFrame, additions: DataFrame) -> DataFrame:
    """Requests of known products with the stock they start from. Without a
    ``seq`` column the order is that of the rows as they are read."""
    seq = F.col("seq").cast("bigint") if "seq" in additions.columns else F.monotonically_increasing_id()
    a = additions.select(seq.alias("seq"), X.php_int("product_id").alias("product_id"),
                         amount(X.php_int("containers")).alias("dc"), amount(X.php_int("loose")).alias("dl"))
    p = products.select(F.col("id").cast("bigint").alias("product_id"), "product_name", X.eff_ppc().alias("ppc"),
                        F.coalesce(F.col("container_quantity").cast("bigint"), F.lit(0)).alias("c0"),
                        F.coalesce(F.col("loose_pieces").cast("bigint"), F.lit(0)).alias("l0"))
    return a.join(p, "product_id", "left")


def restock(products: DataFrame, additions: DataFrame, now=None,
            quick_add: bool = False) -> tuple[DataFrame, DataFrame]:
    """Add containers and loose pieces to existing products (not
    normalised); unknown ids are ignored. With ``quick_add`` the requests
    adding nothing are dropped first, as that form does. Requests run in
    ``seq`` order; one that would take a column out of its range is refused
    alone (``restocking``). Returns (products_after, report with the new total
    pieces per changed product)."""
    if quick_add:
        additions, _refused = quick_add_guard(additions)
    known = _additions(products, additions).where(F.col("ppc").isNotNull())
    ppc = products.select(F.col("id").cast("bigint").alias("product_id"), X.eff_ppc().alias("_ppc"))
    ch = totals(known).join(ppc, "product_id").select(
        "product_id", "requests", F.col("c").alias("container_quantity_new"), F.col("l").alias("loose_pieces_new"), "_ppc")
    report = ch.select("product_id", "requests", F.col("container_quantity_new").alias("container_quantity"),
                       F.col("loose_pieces_new").alias("loose_pieces"),
                       (F.col("container_quantity_new") * F.col("_ppc") + F.col("loose_pieces_new")).alias("total_pieces"))
    after = _keyed_update(products, ch.drop("_ppc", "requests"),
                          {"container_quantity": "container_quantity_new", "loose_pieces": "loose_pieces_new"}, now)
    return after, report


def restock_requests(products: DataFrame, additions: DataFrame, quick_add: bool = False) -> DataFrame:
    """What the page answers to every request, taken in ``seq`` order:
    ``added``, ``refused`` (a column would leave its range), both with the
    stock after it, ``unknown`` (no such product; the page says nothing) or, with
    ``quick_add``, ``nothing`` (the form does not send it)."""
    answers = []
    if quick_add:
        additions, refused = quick_add_guard(additions)
        answers.append(refused.select(
            F.col("seq").cast("bigint").alias("seq"), X.php_int("product_id").alias("product_id"),
            F.lit(NOTHING).alias("status"), F.lit(NOTHING_TO_ADD).alias("message"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("container_quantity", "loose_pieces", "total_pieces")]))
    rows = _additions(products, additions)
    known = rows.where(F.col("ppc").isNotNull())
    names = products.select(F.col("id").cast("bigint").alias("product_id"), "product_name", X.eff_ppc().alias("ppc"))
    done = in_order(known).join(names, "product_id")
    total = F.col("c") * F.col("ppc") + F.col("l")
    added = F.concat(F.lit("Stock successfully added to existing product '"), F.coalesce("product_name", F.lit("")),
                     F.lit("'! Added: "), F.col("dc").cast("string"), F.lit(" containers + "), F.col("dl").cast("string"),
                     F.lit(" pieces. New total: "), total.cast("string"), F.lit(" pieces."))
    ok = F.col("refused").isNull()
    failed = F.format_string((MERGE_FAILED + OUT_OF_RANGE).replace("{}", "%s"), "refused")
    answers.append(done.select(
        "seq", "product_id", F.when(ok, ADDED).otherwise(REFUSED).alias("status"),
        F.when(ok, added).otherwise(failed).alias("message"),
        F.col("c").alias("container_quantity"), F.col("l").alias("loose_pieces"), total.alias("total_pieces")))
    answers.append(rows.where(F.col("ppc").isNull()).select(
        "seq", "product_id", F.lit(UNKNOWN).alias("status"), F.lit(None).cast("string").alias("message"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("container_quantity", "loose_pieces", "total_pieces")]))
    return reduce(DataFrame.unionByName, answers)


def set_stock(products: DataFrame, changes: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """Replace both stock values as given; the last request per product
    wins; unknown ids change nothing."""
    c = changes.select("seq", X.php_int("product_id").alias("product_id"),
                       X.php_int("containers").alias("c"), X.php_int("loose").alias("l"))
    c = c.where(in_int(F.col("c")) & in_int(F.col("l")))    # the database refuses any other value
    last = c.groupBy("product_id").agg(F.max_by(F.struct("c", "l"), "seq").alias("_v"),
                                       F.count(F.lit(1)).alias("requests"))
    known = last.join(products.select(F.col("id").cast("bigint").alias("product_id")), "product_id", "left_semi")
    ch = known.select("product_id", "requests", F.col("_v.c").alias("_cq"), F.col("_v.l").alias("_lp"))
    report = ch.select("product_id", "requests", F.col("_cq").alias("container_quantity"),
                       F.col("_lp").alias("loose_pieces"))
    after = _keyed_update(products, ch.drop("requests"), {"container_quantity": "_cq", "loose_pieces": "_lp"}, now)
    return after, report


def update_prices(products: DataFrame, changes: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """Replace unit prices; a price <= 0 is refused (that request only); the
    last accepted request per product wins. Past sale lines keep their own
    price. Returns (products_after, report of every request)."""
    c = changes.select("seq", X.php_int("product_id").alias("product_id"),
                       X.php_number("new_price").alias("price"))
    c = c.withColumn("message", F.when(F.col("price") <= 0, F.lit(PRICE_POSITIVE))
                     .when(F.col("price") > F.lit(MONEY_MAX), F.lit(OUT_OF_RANGE.format("unit_price"))))
    c = c.withColumn("accepted", F.col("message").isNull())
    last = (c.where("accepted").groupBy("product_id")
            .agg(F.max_by("price", "seq").alias("_price"))
            .join(products.select(F.col("id").cast("bigint").alias("product_id")), "product_id", "left_semi"))
    after = _keyed_update(products, last.select("product_id", F.col("_price").cast("decimal(10,2)").alias("_np")),
                          {"unit_price": "_np"}, now)
    return after, c
