"""Sales and sale items stored in buckets by sale, so that joining or counting
the lines of sales moves neither table.

Both are written as Parquet tables of the session catalog with the same number
of buckets, sales by ``id``, items by ``sale_id``, each bucket sorted by it. The
planner then joins bucket with bucket (``left join`` of the listings, ``group
by sale_id`` of the counts) without an exchange. The files stay where ``path``
says; another session opens them with ``open_tables``.

A bucket should hold a few hundred megabytes at the target scale. A sale has few
lines, so hashing on the sale leaves no hot bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import SALE_ITEMS, SALES

KEYS = {"sales": (SALES, "id"), "sale_items": (SALE_ITEMS, "sale_id")}


def write_table(df: DataFrame, kind: str, name: str, path: str, buckets: int) -> None:
    """Write ``df`` as the ``sales`` or ``sale_items`` table ``name``. Rows meet
    their bucket before the write, so a bucket is one file."""
    tdef, key = KEYS[kind]
    (df.select(*tdef.names).repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))


def open_table(spark: SparkSession, kind: str, name: str, path: str, buckets: int) -> DataFrame:
    """The table of files written before, maybe by another session."""
    tdef, key = KEYS[kind]
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tdef.struct.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING PARQUET "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_tables(sales: DataFrame, sale_items: DataFrame, prefix: str, path: str, buckets: int) -> None:
    write_table(sales, "sales", f"{prefix}_sales", f"{path}/sales", buckets)
    write_table(sale_items, "sale_items", f"{prefix}_sale_items", f"{path}/sale_items", buckets)


def open_tables(spark: SparkSession, prefix: str, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(sales, sale_items)."""
    return (open_table(spark, "sales", f"{prefix}_sales", f"{path}/sales", buckets),
            open_table(spark, "sale_items", f"{prefix}_sale_items", f"{path}/sale_items", buckets))


