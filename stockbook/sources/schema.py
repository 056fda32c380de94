"""Declared schemas of the three domain tables and the job inputs.

Column order, NOT NULL flags, defaults, unique keys, foreign keys and length
limits are the intended schema of the application's database (the base
tables plus the ``loose_pieces`` column that every migration adds). Spark
does not enforce any of these; ``operators.quality`` checks them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)


@dataclass(frozen=True)
class Column:
    name: str
    dtype: T.DataType
    nullable: bool = True
    default: object = None          # python literal, or None for NULL
    max_length: int | None = None   # VARCHAR(n) limit, characters


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[Column, ...]
    primary_key: str = "id"
    unique: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = field(default=())  # (col, table, col)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)


# Column defaults, NOT NULL flags and VARCHAR lengths of the
# application's schema.
PRODUCTS = TableDef(
    "products",
    (
        Column("id", T.IntegerType(), False),
        Column("product_name", T.StringType(), False, max_length=255),
        Column("container_unit", T.StringType(), True, "Piece", 50),
        Column("container_quantity", T.IntegerType(), True, 0),
        Column("pieces_per_container", T.IntegerType(), True, 1),
        Column("individual_unit", T.StringType(), True, "Piece", 50),
        Column("model_size", T.StringType(), True, None, 100),
        Column("description", T.StringType()),
        Column("unit_price", MONEY, False),
        Column("minimum_stock", T.IntegerType(), True, 5),
        Column("supplier_name", T.StringType(), True, None, 255),
        Column("supplier_contact", T.StringType(), True, None, 255),
        Column("created_at", T.TimestampType()),
        Column("updated_at", T.TimestampType()),
        Column("loose_pieces", T.IntegerType(), False, 0),
    ),
)

SALES = TableDef(
    "sales",
    (
        Column("id", T.LongType(), False),
        Column("sale_number", T.StringType(), False, max_length=20),
        Column("total_amount", MONEY, False),
        Column("sale_date", T.TimestampType()),
        Column("staff_name", T.StringType(), True, "Staff", 100),
        Column("customer_name", T.StringType(), True, None, 255),
        Column("customer_address", T.StringType()),
        Column("lpo_number", T.StringType(), True, None, 100),
        Column("notes", T.StringType()),
    ),
    unique=("sale_number",),
)

SALE_ITEMS = TableDef(
    "sale_items",
    (
        Column("id", T.LongType(), False),
        Column("sale_id", T.LongType(), False),
        Column("product_id", T.IntegerType(), False),
        Column("quantity_sold", T.IntegerType(), False),
        Column("unit_type", T.StringType(), True, "piece", 50),
        Column("unit_price", MONEY, False),
        Column("total_price", MONEY, False),
    ),
    foreign_keys=(("sale_id", "sales", "id"), ("product_id", "products", "id")),
)

TABLES = {t.name: t for t in (PRODUCTS, SALES, SALE_ITEMS)}

# Job inputs (not stored tables of the application).
CARTS = T.StructType([
    T.StructField("cart_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("items", T.StringType(), True),       # JSON array posted by the POS form
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("customer_address", T.StringType(), True),
    T.StructField("lpo_number", T.StringType(), True),
    T.StructField("staff_name", T.StringType(), True),
])

STOCK_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("product_id", T.IntegerType(), True),
    T.StructField("kind", T.StringType(), True),        # sale | add | set; others change nothing
    T.StructField("pieces", T.IntegerType(), True),     # sale: pieces deducted
    T.StructField("containers", T.IntegerType(), True), # add / set
    T.StructField("loose", T.IntegerType(), True),      # add / set
])

# One cart line as posted by the browser: every field is read as text and cast
# leniently, like the server does with (int) / trim.
CART_ITEM = T.StructType([
    T.StructField("product_id", T.StringType(), True),
    T.StructField("quantity", T.StringType(), True),
    T.StructField("unit_type", T.StringType(), True),
    T.StructField("unit_price", T.StringType(), True),
])
