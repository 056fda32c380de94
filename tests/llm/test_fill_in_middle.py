import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stockbook.llm import fill_in_middle as M

from . import fixtures

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text, transformed=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= transformed:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    hard = [(r[0], r[1]) for r in fixtures.hard_rows()]
    long_line = "x<" * 30_000
    return hard + [(i, t) for i, t in enumerate(
        ["\n", "\n\n\n", "a\n\nb", "one line", "a<P\n>b", "<S\n<M\nP>", "has <M> mark", "é\r\n漢\n🙂",
         long_line, long_line + "\n" + long_line, "l\n" * 9000, "<\n" * 50, "tail<"], 200)]


key = lambda r: tuple((x is None, x if x is not None else 0) for x in map(lambda v: v if not isinstance(v, str) else sha(v), r))


@pytest.mark.parametrize("chunk", [M.CHUNK, 3])
def test_against_whole_texts(spark, chunk):
    data = [r for r in rows() if chunk > 3 or len(r[1] or "") < 3000]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    want = [brute(*r) for r in data]
    got = [tuple(r) for r in M.digests(M.pieces(docs, chunk=chunk)).collect()]
    assert sorted(got, key=key) == sorted([(*w[:5], sha(w[5]), sha(r[1] or "")) for w, r in zip(want, data, strict=True)], key=key)
    texts = M.fill_in_middle(docs, chunk=chunk)
    assert sorted(map(tuple, texts.collect()), key=key) == sorted(want, key=key)
    back = sorted(map(tuple, M.restore(texts).collect()), key=key)
    assert back == sorted([(i, t or "") for i, t in data], key=key)


def test_rates_and_clashing_columns(spark):
    docs = fixtures.hard_docs(spark)
    got = [tuple(r) for r in M.fill_in_middle(docs, M.Rates(40, 90)).collect()]
    want = [brute(r[0], r[1], 40, 90) for r in fixtures.hard_rows()]
    assert sorted(got, key=key) == sorted(want, key=key) and {"plain", "spm"} <= {r[2] for r in got}
    assert M.digests(M.pieces(fixtures.no_docs(spark))).count() == 0
    assert M.fill_in_middle(fixtures.no_docs(spark)).count() == 0


def test_one_shuffle(spark):
    from stockbook.plans.checks import plan_text
    plan = plan_text(M.digests(M.pieces(fixtures.hard_docs(spark))))
    tree = plan[:plan.index("\n\n")]
    assert tree.count("Exchange") == 1 and tree.count("Sort (") == 2


@given(st.text(alphabet="a\n<PSM>"), st.integers(1, 4))
def test_units_and_chunks(text, size):
    assert M.n_units(text) == len(re.findall(r"[^\n]*\n|[^\n]+", text))
    parts = list(M.chunks(text, 0, len(text), size))
    assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)


@given(st.lists(st.text(alphabet="a<PS>M"), min_size=3, max_size=3), st.integers(1, 5), st.sampled_from(["psm", "spm"]))
def test_splitter(parts, size, form):
    if any(m in p for p in parts for m in ("<P>", "<S>", "<M>")):
        return
    output = "".join(m + p for m, p in zip(M.ORDER[form], parts, strict=True))
    s, got = M.Splitter(form), {}
    runs = [r for i in range(0, len(output), size) for r in s.feed(output[i:i + size])] + [s.end()]
    for mark, text in runs:
        got[mark] = got.get(mark, "") + text
    assert got.pop(None, "") == "" and got == dict(zip(M.ORDER[form], parts, strict=True))
