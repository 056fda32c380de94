"""Accent and case pairs join, match and sort together."""

import duckdb
import pytest

from stockbook.functions import exprs as X
from stockbook.operators import catalog, inventory

NAMES = ["Zoe", "zoé", "ZOË  ", "Apfel", "äpfel", "Ápfel ", "nail", "ÑAIL", "naïl", "box", "Straße", "strasse", "", " "]
SCHEMA = ("id int, product_name string, container_unit string, container_quantity int, pieces_per_container int, individual_unit string, "
          "model_size string, unit_price decimal(10,2), minimum_stock int, supplier_name string, loose_pieces int")


def products(spark):
    from decimal import Decimal
    return spark.createDataFrame([(i, n, "", 1, 1, "", "M é" if i % 2 else None, Decimal("1.00"), 0, None, 0)
                                  for i, n in enumerate(NAMES, 1)], SCHEMA)


def test_equal_and_sorted_as_the_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE n(id INT, v VARCHAR COLLATE NOCASE.NOACCENT)")
    letters = [n for n in NAMES if n.strip() and "ß" not in n and n != "strasse"]
    con.executemany("INSERT INTO n VALUES (?, ?)", [(i, n.rstrip()) for i, n in enumerate(letters)])
    want = con.execute("SELECT a.id, b.id FROM n a JOIN n b ON a.v = b.v ORDER BY 1, 2").fetchall()
    df = spark.createDataFrame(list(enumerate(letters)), "id int, v string")
    key = X.collated("v", X.ACCENT_INSENSITIVE)
    a, b = df.select("id", key.alias("k")).alias("a"), df.select("id", key.alias("k")).alias("b")
    from pyspark.sql import functions as F
    got = a.join(b, F.col("a.k") == F.col("b.k")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > len(letters)
    order = [r["id"] for r in df.orderBy(key, "id").collect()]
    assert order == [r[0] for r in con.execute("SELECT id FROM n ORDER BY v, id").fetchall()]
    assert df.groupBy(key.alias("k")).count().count() == len({tuple(y for x, y in want if x == i) for i, _ in want})


@pytest.mark.parametrize("term,names", [("ZÖE", {"Zoe", "zoé", "ZOË  "}), ("pfél", {"Apfel", "äpfel", "Ápfel "}), ("n_Il", {"nail", "ÑAIL", "naïl"}),
                                        ("a%l", {"Apfel", "äpfel", "Ápfel ", "nail", "ÑAIL", "naïl"}), ("\\%", set()), ("ß", {"Straße"})])
def test_contains(spark, term, names):
    df = spark.createDataFrame([(n,) for n in NAMES], "v string")
    assert {r["v"] for r in df.where(X.contains_collated("v", term, X.ACCENT_INSENSITIVE)).collect()} == names
    plain = {r["v"] for r in df.where(X.contains_ci("v", term)).collect()}
    assert {r["v"] for r in df.where(X.contains_collated("v", term)).collect()} == plain <= names


def test_duplicates_and_lists(spark):
    p = products(spark)
    forms = spark.createDataFrame([(1, "ZÓE", "m e", "1"), (2, "ÄPFEL", "", "1"), (3, "new one", "", "1"), (4, "NEW ÖNE", "", "2")],
                                  "seq long, product_name string, model_size string, unit_price string")
    got = {r["seq"]: (r["status"], r["existing_id"]) for r in catalog.new_product_check(p, forms, X.ACCENT_INSENSITIVE).collect()}
    assert got == {1: ("duplicate", 1), 2: ("duplicate", 4) if 4 % 2 == 0 else ("new", None), 3: ("new", None), 4: ("new", None)}
    full = spark.createDataFrame([], "created_at timestamp, updated_at timestamp, description string, supplier_contact string")
    after, report = catalog.add_products(p.select("*", *[__import__("pyspark").sql.functions.lit(None).cast(f.dataType).alias(f.name)
                                                         for f in full.schema]), forms, collation=X.ACCENT_INSENSITIVE)
    assert {r["seq"]: r["status"] for r in report.collect()} == {1: "duplicate", 2: "duplicate", 3: "new", 4: "duplicate"}
    assert after.count() == len(NAMES) + 1
    names = [r["product_name"] for r in inventory.price_list(p, X.ACCENT_INSENSITIVE).collect()]
    assert names.index("äpfel") < names.index("box") < names.index("ÑAIL") < names.index("zoé")
