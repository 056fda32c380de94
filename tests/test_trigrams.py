"""The posting table finds what the scan finds."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import SF001
from stockbook.functions import exprs as X
from stockbook.operators import receipts as rc
from stockbook.operators import trigrams as tg
from stockbook.plans.checks import plan_text
from stockbook.sources import testmap as tm

VALUES = ["Hot Bolt", "hot bolt", "HOTBOLT", "bolt hot", "a_b%c", "a\\b", "aaaa", "ab", "", None, "100% nut", "Äpfel öl", "ÄPFEL", "x" * 40, "SALE1997"]
TERMS = ["bolt", "hot bolt", "HOT", "ot b", "t_b", "hot%bolt", "a\\_b", "a\\%", "%", "_", "ab", "a", "aaa", "aaaaa", "00%", "0\\% n", "äpf", "ÄPFEL",
         "a\\b", "a\\\\b", "b\\", "xxxx", "zzz", "1997", "%%%", "___", "h_t_b"]


def test_same_rows_as_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "id int, v string")
    tg.write_postings(rows.where("id < 7"), "v", str(tmp_path / "grams"))
    tg.add_postings(rows.where("id >= 6"), "v", str(tmp_path / "grams"))        # row 6 twice
    index = tg.read_postings(spark, str(tmp_path / "grams"))
    for term in TERMS:
        want = sorted(r["id"] for r in rows.where(X.contains_ci("v", term)).collect())
        assert sorted(r["id"] for r in tg.contains(rows, index, "v", term).collect()) == want, term


def test_grams_of_terms():
    assert tg.term_grams("hot bolt") == sorted({"hot", "ot ", "t b", " bo", "bol", "olt"})
    assert tg.term_grams("ab%cd_ef") == [] and tg.term_grams("a\\%b") == ["a%b"] and tg.term_grams("ABC") == ["abc"]


@given(st.text(alphabet="ab%_\\", max_size=8), st.text(alphabet="ab%_\\", max_size=8))
def test_a_match_has_all_grams(value, term):
    import re
    pattern, out, chars = X.like_pattern(term), "", iter(X.like_pattern(term))
    for ch in chars:
        out += ".*" if ch == "%" else "." if ch == "_" else re.escape(next(chars) if ch == "\\" else ch)
    if re.fullmatch(out, value, re.S):
        assert all(g in value.lower() for g in tg.term_grams(term)), pattern


@pytest.mark.parametrize("term", ["19970115", "SALE19970", "no such", "7", "1997_115", "%"])
def test_receipt_searches(spark, term):
    s, i = tm.sales(spark, SF001), tm.sale_items(spark, SF001)
    index = tg.postings(s, "sale_number")
    assert rc.receipts_by_number(s, i, term, index).collect() == rc.receipts_by_number(s, i, term).collect()


def test_scan_of_postings_is_pushed_down(spark, tmp_path):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "id int, v string")
    tg.write_postings(rows, "v", str(tmp_path / "grams"))
    plan = plan_text(tg.candidates(tg.read_postings(spark, str(tmp_path / "grams")), "hot bolt"))
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(" in plan or "EqualTo(gram" in plan
    assert tg.candidates(rows, "ab") is None
