from datetime import datetime

from pyspark.sql import functions as F

from stockbook.functions import exprs as X


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_php_int_lenient(spark):
    vals = ["2.7", "3abc", "1e3", "", None, "  12", "-5", "abc", ".5", "7 "]
    got = _one(spark, X.php_int("v"), [(v,) for v in vals], "v string")
    assert got == [2, 3, 1000, 0, 0, 12, -5, 0, 0, 7]


def test_php_trim_and_fallback(spark):
    got = _one(spark, X.php_trim("v"), [(" \t a b\n\x0b",), ("x\x00",)], "v string")
    assert got == ["a b", "x"]
    got = _one(spark, X.php_fallback("v", "Walk-in"), [(None,), ("",), ("0",), ("00",), ("Ann",)], "v string")
    assert got == ["Walk-in", "Walk-in", "Walk-in", "00", "Ann"]


def test_like_pattern_mysql_escapes():
    assert X.like_pattern("a\\b") == "%ab%"
    assert X.like_pattern("50\\%") == "%50\\%%"
    assert X.like_pattern("x\\") == "%x\\\\%"
    assert X.like_pattern("a_b%") == "%a_b%%"


def test_contains_ci(spark):
    rows = [("Hot Bolt",), ("hot  bolt",), ("SHOT BOLTS",), (None,)]
    got = _one(spark, X.contains_ci("v", "hot bolt"), rows, "v string")
    assert got == [True, False, True, None]


def test_sale_date_format(spark):
    rows = [(datetime(2024, 1, 2, 0, 5),), (datetime(2024, 1, 2, 12, 5),), (datetime(2024, 1, 2, 23, 59, 59),)]
    got = _one(spark, X.fmt_sale_date("t"), rows, "t timestamp")
    assert got == ["2024-01-02 12:05 AM", "2024-01-02 12:05 PM", "2024-01-02 11:59 PM"]


def test_number_format_half_up(spark):
    got = _one(spark, X.number_format(F.col("v").cast("decimal(10,3)")), [("1234.565",), ("0.005",)], "v string")
    assert got == ["1,234.57", "0.01"]


def test_stock_rules(spark):
    schema = ("container_quantity int, pieces_per_container int, loose_pieces int, minimum_stock int, "
              "container_unit string, individual_unit string")
    rows = [(2, 0, None, 5, "Box", "Piece"),    # ppc 0 -> 1
            (2, None, 1, 5, "Box", ""),         # ppc NULL -> 1, unit fallback
            (1, 10, 13, 5, "", "Piece"),        # loose >= ppc; unit '' -> containers
            (0, 4, 0, 5, "Sack", "Piece"),      # out of stock
            (1, 4, 1, 5, "Sack", "Piece"),      # total = minimum -> low
            (-1, 4, 1, 5, "Sack", "Piece")]     # negative stock
    df = spark.createDataFrame(rows, schema).select(
        X.eff_ppc().alias("ppc"), X.total_pieces().alias("total_pieces"), "*")
    out = df.select("total_pieces", X.stock_status("total_pieces").alias("st"),
                    X.stock_label_overview().alias("ov"), X.stock_label_pos().alias("pos"),
                    X.stock_label_edit().alias("ed"), X.dashboard_low_stock().alias("dash")).collect()
    assert [r.total_pieces for r in out] == [2, 3, 23, 0, 5, -3]
    assert [r.st for r in out] == ["Low Stock", "Low Stock", "In Stock", "Out of Stock", "Low Stock", "Low Stock"]
    assert out[0].ov == "2 Piece" and out[1].ov == "3 pieces" and out[1].ed == "3 pieces"
    assert out[2].ov == "2 containers 3 pieces"
    assert out[4].ov == "1 Sack 1 pieces"
    # a negative remainder shows in the picker label only
    assert out[5].ov == "0 Sack" and out[5].pos == "0 Sack -3 pieces"
    # dashboard rule: containers * ppc <= minimum, NULL ppc not counted
    assert [r.dash for r in out] == [True, False, False, True, True, True]


def test_format_stock_display(spark):
    rows = [(1, 1), (3, 1), (1, 6), (2, 6), (2, 0), (2, None)]
    got = _one(spark, X.format_stock_display(), rows, "container_quantity int, pieces_per_container int")
    assert got == ["1 piece", "3 pieces", "1 container", "2 containers", None, None]


def test_container_unit(spark):
    rows = [("Box",), ("BOXES",), ("container",), ("Sack",), ("bundle",), ("Gallon",), ("",), (None,)]
    server = _one(spark, X.is_container_unit("u"), rows, "u string")
    browser = _one(spark, X.is_container_unit("u", case_sensitive=True), rows, "u string")
    assert server == [True, True, True, True, True, False, False, False]
    assert browser == [False, False, True, False, True, False, False, False]


def test_sale_number(spark):
    got = _one(spark, X.sale_number(F.col("d"), F.col("n")), [(datetime(2024, 3, 9), 42)], "d timestamp, n int")
    assert got == ["SALE2024030900000042"]
