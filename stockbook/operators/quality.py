"""Schema conformance and integrity checks.

The application evolves its tables with "add the column if it is missing"
scripts and relies on the database for NOT NULL, UNIQUE, foreign keys and
length limits. Spark enforces none of these, so:

* ``conform_schema`` brings a DataFrame to the declared schema (missing
  columns get their default, existing ones keep their values);
* ``schema_report`` lists declared columns against what a table has, with
  row counts;
* ``integrity_report`` counts violations of every declared rule, each rule
  one aggregate or anti join over the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import PRODUCTS, SALE_ITEMS, SALES, TABLES, TableDef


def conform_schema(df: DataFrame, table: TableDef) -> DataFrame:
    """Declared columns in declared order (missing ones = default, cast to
    the declared type), then any extra columns unchanged."""
    have = set(df.columns)
    cols = []
    for c in table.columns:
        if c.name in have:
            cols.append(F.col(c.name).cast(c.dtype).alias(c.name))
        else:
            cols.append(F.lit(c.default).cast(c.dtype).alias(c.name))
    extra = [F.col(c) for c in df.columns if c not in {x.name for x in table.columns}]
    return df.select(*cols, *extra)


def schema_report(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per declared column: declared type, required, default,
    whether the table has it and with which type, and the table's row count
    (NULL when the table is missing)."""
    meta, counts = [], []
    for name, tdef in TABLES.items():
        df = tables.get(name)
        present = {f.name: f.dataType.simpleString() for f in df.schema.fields} if df is not None else {}
        for pos, c in enumerate(tdef.columns, start=1):
            meta.append((name, pos, c.name, c.dtype.simpleString(), not c.nullable,
                         None if c.default is None else str(c.default),
                         c.name in present, present.get(c.name)))
        if df is not None:
            counts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count"))
    m = spark.createDataFrame(meta, "table string, position int, column string, declared_type string, "
                                    "required boolean, default string, present boolean, actual_type string")
    if not counts:
        return m.withColumn("row_count", F.lit(None).cast("bigint"))
    return m.join(reduce(DataFrame.unionByName, counts), "table", "left")


def _rule(table: str, rule: str, column: str, n) -> DataFrame:
    return n.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(column).alias("column"),
                    F.col("violations").cast("bigint").alias("violations"))


def _column_rules(df: DataFrame, tdef: TableDef) -> DataFrame:
    """NOT NULL and length limits of one table: one aggregate pass, then the
    one-row result is unpivoted to one row per rule."""
    aggs, keys = [], []
    for c in tdef.columns:
        if not c.nullable and c.name != tdef.primary_key:
            keys.append(("not_null", c.name))
            aggs.append(F.count_if(F.col(c.name).isNull()))
        if c.max_length:
            keys.append((f"max_length_{c.max_length}", c.name))
            aggs.append(F.count_if(F.length(c.name) > c.max_length))
    keys.append(("not_null", tdef.primary_key))
    aggs.append(F.count_if(F.col(tdef.primary_key).isNull()))
    row = df.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"),
                                    a.cast("bigint").alias("violations"))
                           for (r, c), a in zip(keys, aggs)]).alias("_r"))
    return row.select(F.explode("_r").alias("_r")).select(
        F.lit(tdef.name).alias("table"), "_r.rule", "_r.column", "_r.violations")


def _duplicates(df: DataFrame, table: str, column: str, rule: str) -> DataFrame:
    """Rows whose key value occurs more than once."""
    d = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
         .where(F.col("n") > 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
    return _rule(table, rule, column, d)


def _orphans(child: DataFrame, col: str, parent: DataFrame, pcol: str, table: str) -> DataFrame:
    o = (child.select(col).where(F.col(col).isNotNull())
         .join(parent.select(F.col(pcol).alias(col)), col, "left_anti")
         .agg(F.count(F.lit(1)).alias("violations")))
    return _rule(table, "foreign_key", col, o)


def integrity_report(products: DataFrame, sales: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Violations per (table, rule, column); 0 rows violating is reported too."""
    parts = []
    for df, tdef in ((products, PRODUCTS), (sales, SALES), (sale_items, SALE_ITEMS)):
        parts.append(_column_rules(df, tdef))
        parts.append(_duplicates(df, tdef.name, tdef.primary_key, "primary_key"))
    parts.append(_duplicates(sales, "sales", "sale_number", "unique"))
    parts.append(_orphans(sale_items, "sale_id", sales, "id", "sale_items"))
    parts.append(_orphans(sale_items, "product_id", products, "id", "sale_items"))
    return reduce(DataFrame.unionByName, parts)


def integrity_rules() -> list[tuple[str, str, str]]:
    """(table, rule, column) of every check ``integrity_report`` runs."""
    out = []
    for tdef in (PRODUCTS, SALES, SALE_ITEMS):
        for c in tdef.columns:
            if not c.nullable and c.name != tdef.primary_key:
                out.append((tdef.name, "not_null", c.name))
            if c.max_length:
                out.append((tdef.name, f"max_length_{c.max_length}", c.name))
        out.append((tdef.name, "not_null", tdef.primary_key))
        out.append((tdef.name, "primary_key", tdef.primary_key))
    out += [("sales", "unique", "sale_number"), ("sale_items", "foreign_key", "sale_id"),
            ("sale_items", "foreign_key", "product_id")]
    return out


__all__ = ["conform_schema", "schema_report", "integrity_report", "integrity_rules"]
