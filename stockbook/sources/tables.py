"""Reading and publishing the application tables as Parquet.

Layout under one root folder (shared storage on a cluster)::

    <root>/products/batch=<b>/...   full snapshot written by batch b
    <root>/sales/batch=<b>/...      rows appended by batch b
    <root>/sale_items/batch=<b>/... rows appended by batch b
    <root>/_commits/<b>[.<origin>]   marker, written last; <origin> names what
                                     was published (a stream's batch), so a
                                     replay finds it under any number

A batch is visible only once its marker exists, so the header, lines and
stock of a checkout appear together or not at all; a replayed batch whose
marker exists is skipped (idempotent). Readers prune to committed batch
folders (partition pruning on ``batch``). Sales are also partitioned by
sale month inside a batch, so date filters prune files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import PRODUCTS, SALE_ITEMS, SALES, TableDef

APPEND_TABLES = ("sales", "sale_items")


def read_table(spark: SparkSession, path: str, table: TableDef) -> DataFrame:
    """Full scan with the declared schema (no inference)."""
    return spark.read.schema(table.struct).parquet(path)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Keyed lookup of one row (pushed to the Parquet scan as a filter)."""
    return df.where(F.col(column) == F.lit(value))


class TableStore:
    """Versioned, commit-marker-published tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- file system through the JVM's Hadoop client (works for any FS) --
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_commits")
        if not fs.exists(p):
            return []
        return sorted(self._markers())

    def _markers(self) -> dict[int, str]:
        """Marker names by batch number."""
        fs, p = self._fs(f"{self.root}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n.partition(".")[0]): n for n in names if n.partition(".")[0].isdigit()}

    def is_committed(self, batch: int) -> bool:
        return int(batch) in self._markers()

    def has_origin(self, origin: str) -> bool:
        """Whether a batch of this origin was published, under any number."""
        return any(n.partition(".")[2] == origin for n in self._markers().values())

    def next_batch(self) -> int:
        return max(self._markers(), default=-1) + 1

    def _commit(self, batch: int, meta: dict | None = None, origin: str | None = None) -> None:
        fs, p = self._fs(f"{self.root}/_commits/{int(batch)}" + (f".{origin}" if origin else ""))
        out = fs.create(p, False)     # a second writer of the same batch fails here
        out.write(bytearray(json.dumps(meta or {}).encode()))
        out.close()

    def meta(self, batch: int | None = None) -> dict:
        """The small record kept with a published batch (default: the latest)."""
        done = self._markers()
        if not done:
            return {}
        b = max(done) if batch is None else int(batch)
        line = self.spark.read.text(f"{self.root}/_commits/{done[b]}").first()
        return json.loads(line[0]) if line and line[0] else {}

    # -- reads --
    def _read(self, name: str, tdef: TableDef) -> tuple[DataFrame, list[int]] | None:
        done = self.committed()
        if not done:
            return None
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        schema = T.StructType([*tdef.struct.fields, T.StructField("batch", T.IntegerType())])
        if name == "sales":
            schema = schema.add("sale_month", T.StringType())
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}"), done

    def products(self) -> DataFrame | None:
        r = self._read("products", PRODUCTS)
        if r is None:
            return None
        df, done = r
        # newest committed batch that wrote a snapshot (a folder listing, no scan)
        latest = next((b for b in reversed(done)
                       if self._fs(f"{self.root}/products/batch={b}")[0].exists(
                           self._fs(f"{self.root}/products/batch={b}")[1])), None)
        if latest is None:
            return None
        return df.where(F.col("batch") == F.lit(latest)).select(*PRODUCTS.names)

    def appended(self, name: str) -> DataFrame | None:
        tdef = {"sales": SALES, "sale_items": SALE_ITEMS}[name]
        r = self._read(name, tdef)
        if r is None:
            return None
        df, done = r
        # sales keep their month partition column, so date filters of the
        # reports (``operators.sales.in_days``) prune month folders
        extra = ["sale_month"] if name == "sales" else []
        # committed numbers are 0..last but for the few that failed
        gaps = sorted(set(range(done[-1] + 1)) - set(done))
        seen = F.col("batch") <= done[-1]
        return df.where(seen & ~F.col("batch").isin(gaps) if gaps else seen).select(*tdef.names, *extra)

    # -- writes --
    def publish(self, batch: int, products: DataFrame | None = None,
                appends: dict[str, DataFrame] | None = None, meta: dict | None = None,
                origin: str | None = None) -> bool:
        """Write one batch and publish it; False when it was already
        published (a replay). What an unpublished attempt left in the batch's
        folders is removed first, so the retry's rows are all there is. The
        record ``meta`` continues that of the batch before."""
        if self.is_committed(batch) or origin is not None and self.has_origin(origin):
            return False
        for name in ("products", *APPEND_TABLES):
            fs, p = self._fs(f"{self.root}/{name}/batch={int(batch)}")
            fs.delete(p, True)
        meta = self.meta() | (meta or {})
        for name, df in (appends or {}).items():
            w = df.withColumn("batch", F.lit(int(batch)))
            parts = ["batch"]
            if name == "sales":
                w = w.withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
                parts.append("sale_month")
            (w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*parts).parquet(f"{self.root}/{name}"))
        if products is not None:
            (products.withColumn("batch", F.lit(int(batch))).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/products"))
        self._commit(batch, meta, origin)
        return True


def delete_cascade(products: DataFrame, sales: DataFrame, sale_items: DataFrame,
                   product_ids: DataFrame | None = None, sale_ids: DataFrame | None = None):
    """Delete parents and the child rows that reference them (ON DELETE
    CASCADE). ``product_ids`` / ``sale_ids`` are DataFrames with an ``id``
    column. Returns the three new tables. A full wipe is deleting all ids."""
    if product_ids is not None:
        ids = product_ids.select("id")
        products = products.join(ids, "id", "left_anti")
        sale_items = sale_items.join(ids.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    if sale_ids is not None:
        ids = sale_ids.select("id")
        sales = sales.join(ids, "id", "left_anti")
        sale_items = sale_items.join(ids.withColumnRenamed("id", "sale_id"), "sale_id", "left_anti")
    return products, sales, sale_items
