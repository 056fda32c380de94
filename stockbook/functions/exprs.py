"""Column expressions for the application's per-row rules.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions``, so they stay inside whole-stage codegen; there is
no Python UDF in the package. Names follow the rule they implement.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# Fixed values of the application (kept verbatim, in one place).
# ----------------------------------------------------------------------------
# Date rendering used by every sales listing: MySQL '%Y-%m-%d %h:%i %p'.
SALE_DATE_FORMAT = "yyyy-MM-dd hh:mm a"
# Unit words that make a cart line count whole containers.
CONTAINER_WORDS = ("box", "container", "sack", "bundle")
# Characters removed by the server's trim().
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
# Fallback texts shown for empty values.
WALK_IN_CUSTOMER = "Walk-in Customer"
RECEIPT_CUSTOMER = "Customer"
RECEIPT_ADDRESS = "Address not provided"
DEFAULT_STAFF = "Staff"
NO_VALUE = "-"
NO_MODEL = "No model"
# Stock status words.
OUT_OF_STOCK = "Out of Stock"
LOW_STOCK = "Low Stock"
IN_STOCK = "In Stock"
# Sale number prefix.
SALE_PREFIX = "SALE"

_CONTAINER_PATTERN = "|".join(CONTAINER_WORDS)
# Leading numeric text as PHP reads it when casting a string to a number.
_PHP_NUMERIC_PREFIX = r"^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------
# Text and casts
# ----------------------------------------------------------------------------
def php_trim(c) -> Column:
    """trim() with the server's character set (space, tab, NL, CR, NUL, VT)."""
    return F.btrim(col(c), F.lit(PHP_TRIM_CHARS))


def php_falsy_str(c) -> Column:
    """True where a string is falsy for the server: NULL, '' or '0'."""
    c = col(c)
    return c.isNull() | c.isin("", "0")


def php_fallback(c, default: str) -> Column:
    """``$x ?: default`` on a string column."""
    return F.when(php_falsy_str(c), F.lit(default)).otherwise(col(c))


def php_number(c) -> Column:
    """(float) of a string: its leading numeric text, else 0."""
    txt = F.regexp_extract(col(c).cast("string"), _PHP_NUMERIC_PREFIX, 1)
    return F.coalesce(txt.try_cast("double"), F.lit(0.0))


def php_int(c) -> Column:
    """(int) of a string: '2.7'->2, '3abc'->3, '1e3'->1000, ''->0, NULL->0.
    Whole numbers do not pass through double; beyond bigint they saturate."""
    plain = col(c).cast("string")       # mostly digits alone, which need no further reading
    txt = F.regexp_extract(col(c).cast("string"), _PHP_NUMERIC_PREFIX, 1)
    limit = F.when(txt.startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return (F.when(plain.rlike(r"\A[0-9]{1,18}\z"), plain.try_cast("bigint"))
            .when(txt.rlike("^[+-]?[0-9]+$"), F.coalesce(txt.try_cast("bigint"), limit))
            .otherwise(F.coalesce(php_number(c).try_cast("bigint"), F.lit(0))).cast("bigint"))


def fmt_sale_date(c) -> Column:
    """DATE_FORMAT(ts, '%Y-%m-%d %h:%i %p')."""
    return F.date_format(col(c), SALE_DATE_FORMAT)


def number_format(c, decimals: int = 2) -> Column:
    """number_format(x, d): thousands separators, half away from zero."""
    return F.format_number(F.round(col(c), decimals), decimals)


def money_text(c, prefix: str = "$") -> Column:
    return F.concat(F.lit(prefix), number_format(c, 2))


def like_pattern(term: str) -> str:
    """'%term%' with MySQL's LIKE escape rules made explicit for Spark.

    In MySQL a backslash escapes the next character, and a backslash before an
    ordinary letter stands for that letter; a trailing backslash is literal.
    ``%`` and ``_`` typed by the user stay wildcards (the application does not
    escape them).
    """
    out = []
    i = 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            if i + 1 < len(term):
                nxt = term[i + 1]
                out.append("\\" + nxt if nxt in "%_\\" else nxt)
                i += 2
                continue
            out.append("\\\\")
        else:
            out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def contains_ci(c, term: str) -> Column:
    """``c LIKE '%term%'`` under a case-insensitive collation."""
    return F.lower(col(c)).like(like_pattern(term).lower())


# ----------------------------------------------------------------------------
# Collation
# ----------------------------------------------------------------------------
# A deployment whose columns have an accent-insensitive, blank-padding
# collation (the database's usual default) passes this one.
ACCENT_INSENSITIVE = "UNICODE_CI_AI_RTRIM"


def collated(c, collation: str | None = None) -> Column:
    """A text for equality, joins, grouping and sorting under ``collation``;
    without one, letter case alone is ignored."""
    return F.collate(col(c), collation) if collation else F.lower(col(c))


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with accents, and their base letters."""
    pairs = []
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        whole = chr(code).lower()
        base, *marks = unicodedata.normalize("NFD", whole)
        if len(whole) == 1 and marks and all(unicodedata.combining(m) for m in marks):
            pairs.append((whole, base))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c) -> Column:
    """Lower case without accents and trailing blanks: what LIKE compares under
    an accent-insensitive collation, character by character (Spark's LIKE takes
    no such collation)."""
    return F.rtrim(F.translate(F.lower(col(c)), *_accents()))


def contains_collated(c, term: str, collation: str | None = None) -> Column:
    """``c LIKE '%term%'`` under ``collation``; ``contains_ci`` without one.
    A collation is taken to ignore accents if its name says ``AI``."""
    if not collation or "AI" not in collation.split("_"):
        return contains_ci(c, term)
    marks = str.maketrans(*_accents())
    return folded(c).like(like_pattern(term).lower().translate(marks))


# ----------------------------------------------------------------------------
# Dates
# ----------------------------------------------------------------------------
def sale_day(c) -> Column:
    """DATE(ts)."""
    return F.to_date(col(c))


def date_between(c, date_from, date_to) -> Column:
    """DATE(ts) BETWEEN a AND b (inclusive). A bound that is not a date
    gives no rows. Catalyst rewrites the date comparison into a range on the
    raw timestamp, which reaches the Parquet scan as pushed filters."""
    lo = F.lit(date_from).try_cast("date")
    hi = F.lit(date_to).try_cast("date")
    return sale_day(c).between(lo, hi)


# ----------------------------------------------------------------------------
# Stock arithmetic
# ----------------------------------------------------------------------------
def eff_ppc(ppc="pieces_per_container") -> Column:
    """max(1, (int)pieces_per_container)."""
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(col(ppc).cast("bigint"), F.lit(0).cast("bigint")))


def total_pieces(cq="container_quantity", ppc="pieces_per_container", loose="loose_pieces") -> Column:
    """containers * max(1, ppc) + loose, NULL counted as 0, as bigint."""
    return (F.coalesce(col(cq).cast("bigint"), F.lit(0).cast("bigint")) * eff_ppc(ppc)
            + F.coalesce(col(loose).cast("bigint"), F.lit(0).cast("bigint")))


def stock_status(total, minimum="minimum_stock") -> Column:
    """Inventory page rule: 0 -> out, <= minimum -> low, else in stock."""
    m = F.coalesce(col(minimum).cast("bigint"), F.lit(0).cast("bigint"))
    return (F.when(col(total) == 0, F.lit(OUT_OF_STOCK))
            .when(col(total) <= m, F.lit(LOW_STOCK))
            .otherwise(F.lit(IN_STOCK)))


def dashboard_low_stock(cq="container_quantity", ppc="pieces_per_container",
                        minimum="minimum_stock") -> Column:
    """Dashboard rule: containers * ppc <= minimum (no loose, no max(1, .));
    NULL anywhere makes it false, as in a SQL WHERE."""
    return F.coalesce(col(cq).cast("bigint") * col(ppc).cast("bigint") <= col(minimum).cast("bigint"),
                      F.lit(False))


def calc_total_pieces(cq="container_quantity", ppc="pieces_per_container") -> Column:
    """The helper calculateTotalPieces: containers * ppc."""
    return col(cq).cast("bigint") * col(ppc).cast("bigint")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def format_stock_display(cq="container_quantity", ppc="pieces_per_container") -> Column:
    """The helper formatStockDisplay; NULL where ppc is 0 or NULL (the
    original divides by zero there)."""
    c = col(cq).cast("bigint")
    p = col(ppc).cast("bigint")
    c0 = F.coalesce(c, F.lit(0).cast("bigint"))
    total = c0 * p
    full = (total / p).cast("bigint")
    rem = total % p
    multi = F.concat(full.cast("string"), F.lit(" "), _plural(full, "container", "containers"),
                     F.when(rem == 0, F.lit("")).otherwise(
                         F.concat(F.lit(" "), rem.cast("string"), F.lit(" pieces"))))
    return (F.when(p == 1, F.concat(c0.cast("string"), F.lit(" "), _plural(c0, "piece", "pieces")))
            .when(p.isNull() | (p == 0), F.lit(None).cast("string"))
            .otherwise(multi))


def _split_label(total: Column, ppc: Column, container_unit: Column, show_loose: Column) -> Column:
    # intdiv: (total - total % ppc) is an exact multiple, so the quotient is exact
    containers = ((total - total % ppc) / ppc).cast("bigint")
    loose = total % ppc
    return F.concat(containers.cast("string"), F.lit(" "),
                    php_fallback(container_unit, "containers"),
                    F.when(show_loose, F.concat(F.lit(" "), loose.cast("string"), F.lit(" pieces")))
                    .otherwise(F.lit("")))


def stock_label_overview(total="total_pieces", ppc="ppc", individual_unit="individual_unit",
                         container_unit="container_unit") -> Column:
    """Inventory overview label: ppc 1 -> 'N unit', else 'C unit[ L pieces]'
    with the loose part only when positive."""
    t, p = col(total), col(ppc)
    return (F.when(p == 1, F.concat(t.cast("string"), F.lit(" "), php_fallback(individual_unit, "pieces")))
            .otherwise(_split_label(t, p, col(container_unit), (t % p) > 0)))


def stock_label_pos(total="total_pieces", ppc="ppc", individual_unit="individual_unit",
                    container_unit="container_unit") -> Column:
    """Point-of-sale picker label: like the overview, but any non-zero loose
    remainder is shown (also a negative one)."""
    t, p = col(total), col(ppc)
    return (F.when(p == 1, F.concat(t.cast("string"), F.lit(" "), php_fallback(individual_unit, "pieces")))
            .otherwise(_split_label(t, p, col(container_unit), (t % p) != 0)))


def stock_label_edit(total="total_pieces", ppc="ppc", container_unit="container_unit") -> Column:
    """Stock update / quick-add label: ppc 1 -> always 'N pieces'."""
    t, p = col(total), col(ppc)
    return (F.when(p == 1, F.concat(t.cast("string"), F.lit(" pieces")))
            .otherwise(_split_label(t, p, col(container_unit), (t % p) > 0)))


def is_container_unit(unit, case_sensitive: bool = False) -> Column:
    """Unit text names a container (box / container / sack / bundle).

    The server tests case-insensitively; the browser preview tests the raw
    text (``case_sensitive=True``)."""
    u = col(unit)
    return F.coalesce((u if case_sensitive else F.lower(u)).rlike(_CONTAINER_PATTERN), F.lit(False))


def sale_number(day, n, width: int = 8) -> Column:
    """'SALE' + yyyymmdd + per-day number, zero-padded to ``width`` (20
    characters); a longer number is kept whole."""
    text = col(n).cast("string")
    return F.concat(F.lit(SALE_PREFIX), F.date_format(col(day), "yyyyMMdd"),
                    F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def money(c) -> Column:
    return col(c).cast("decimal(10,2)")
