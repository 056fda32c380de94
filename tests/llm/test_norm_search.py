import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stockbook.llm import norm_search as S

from . import fixtures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n_docs, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        rows = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(words(text)).items() if t in c)
            if score > 0:
                rows.append((score, d))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(rows[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(n):
        text = " ".join(vocabulary[min(299, int(rng.paretovariate(0.6)))] for _ in range(rng.randint(1, 90)))
        docs.append((d, text))
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]                      # copies: ties
    items = [(i, " ".join(rng.choice(docs)[1].split()[:12]) + " W3, w3") for i in range(40)]
    return docs, items


@pytest.mark.parametrize("kw", [{}, {"bucket": 16, "rows_per_range": 100, "block_terms": 200}, {"top": 3, "bucket": 50}])
def test_against_all_documents(spark, kw):
    docs, items = corpus()
    found = S.top_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                            spark.createDataFrame(items, "item_id bigint, text string"), **kw)
    assert got(found) == brute(docs, items, kw.get("top", 10))


def test_hard_rows_and_nothing(spark):
    docs = fixtures.hard_docs(spark)
    rows = [(r[0], r[1]) for r in fixtures.hard_rows() if r[0] is not None]
    items = [(1, rows[0][1]), (1, rows[0][1]), (2, None), (3, ""), (4, " ,.!"), (5, "Ünïcödé 漢字 don't WORD"), (6, "nowhere"), (7, "the the of")]
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, query int, doc_id int")
    assert got(S.top_documents(docs.where("doc_id is not null"), table)) == brute(rows, [i for i in items if i[1]])
    # a null doc_id comes after all others of its score
    last = lambda d: 10**9 if d is None else d
    found = [(r["item_id"], r["rank"], last(r["doc_id"]), r["score"])
             for r in S.top_documents(docs, table.where("item_id = 7"), top=50).collect()]
    assert sorted(found) == brute([(last(r[0]), r[1]) for r in fixtures.hard_rows()], [items[-1]], 50)
    assert S.top_documents(fixtures.no_docs(spark), table).count() == 0
    assert S.top_documents(docs, table.where("item_id < 0")).count() == 0
    assert S.top_documents(docs.where("text is null"), table).count() == 0


def test_rows_that_share_an_item(spark):
    docs, _ = corpus(100)
    table = spark.createDataFrame([(1, "w1 w2"), (1, "w5 w6")], "item_id bigint, text string")
    found = got(S.top_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), table))
    both = sorted(((s, d) for _, _, d, s in brute(docs, [(1, "w1 w2")]) + brute(docs, [(1, "w5 w6")])), key=lambda r: (-r[0], r[1]))
    assert found == [(1, i + 1, d, s) for i, (s, d) in enumerate(both[:10])]


def test_bounds_prune_and_lose_nothing():
    """Buckets in falling norm: whole buckets and most documents are left out."""
    rng = np.random.default_rng(3)
    block = S.Block(np.arange(5), np.arange(0, 16, 3)[:6], rng.integers(0, 50, 15), np.ones(15, np.int64), {})
    block.terms = np.concatenate([rng.choice(50, 3, replace=False) for _ in range(5)])
    weights = rng.integers(100, 9000, 50)
    searcher = S.Searcher(block, weights, np.zeros(5, np.int64), 10)
    docs = [(i, rng.choice(50, 6, replace=False), rng.integers(1, 900_000, 6) // (1 + i // 200)) for i in range(4000)]
    docs.sort(key=lambda d: -np.sqrt((d[2].astype(float) ** 2).sum()))
    for at in range(0, 4000, 250):
        part = docs[at:at + 250]
        searcher.bucket([d[0] for d in part], np.array([np.sqrt((d[2].astype(float) ** 2).sum()) for d in part]),
                        np.concatenate([d[1] for d in part]), np.concatenate([d[2] for d in part]), np.full(len(part), 6))
    want = []
    for q in range(5):
        value = dict(zip(block.terms[3 * q:3 * q + 3], weights[block.terms[3 * q:3 * q + 3]]))
        scores = sorted(((-int(sum(int(value.get(t, 0)) * int(x) for t, x in zip(d[1], d[2]))), d[0]) for d in docs))
        want += [(q, d, -s) for s, d in scores[:10]]
    assert list(searcher.results()) == want
    assert searcher.skipped > 5 * 8 and searcher.scored < 5 * 4000 / 8


@given(st.text(alphabet=st.sampled_from(list("aZ09 _-'\n\x7f\x80éÉ漢ÿ🙂"))))
def test_terms(text):
    assert [t.decode() for t in S.terms_of(text)] == words(text)
