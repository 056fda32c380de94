import random

import numpy as np
import pytest

from stockbook.llm import shingle_join as J
from stockbook.llm.components import connected_components

from . import fixtures


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return [(r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)]


def edited_copies(n=90, copies=14, seed=5):
    """Documents with chains of edited copies and passages that all share."""
    rng = random.Random(seed)
    shared = fixtures.sentence(rng, 12)
    rows = []
    for d in range(n // copies):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(6, 120))]
        for c in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), shared.upper() + " " + " ".join(own) + (" end" if c % 5 == 0 else "")))
    return rows + [(1000 + i, " ".join(f"t{j}" for j in range(i % 9))) for i in range(20)]


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("hot,block", [(8, 2048), (3, 5)])
def test_against_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = edited_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in J.ngram_jaccard_join(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_hard_rows_and_nothing(spark):
    got = [tuple(r) for r in J.ngram_jaccard_join(fixtures.hard_docs(spark)).collect()]
    assert sorted(got, key=key) == sorted(brute(fixtures.hard_rows()), key=key)
    kept = J.keep_one(fixtures.hard_docs(spark))
    assert kept.columns == fixtures.hard_docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, _, c in brute(fixtures.hard_rows()) if i == c and i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 1     # of the rows without id one copies a row that has an id
    assert J.ngram_jaccard_join(fixtures.no_docs(spark)).count() == 0


def test_linked_sets_share_signatures_and_pass_sketches():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, len(a) // 6 + 2))):
            if rng.random() < 0.5 and len(b) > 1:
                b = np.delete(b, rng.integers(len(b)))
            else:
                b = np.unique(np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64)))
        if J.linked(a, b):
            sa, slack = J.signatures(a)
            sb, _ = J.signatures(b)
            assert np.intersect1d(sa, sb).size
            assert J.may_link(J.sketch(a), J.sketch(b), len(a), len(b))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (3, 10), (20, 20)] + [(50, 50 + i) for i in range(1, 40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 10)) and all(got[i] == 6 for i in (6, 7, 8, 9)) and got[89] == 50


def test_keep_one_judges_rows_by_their_own_text(spark):
    rng = random.Random(11)
    a, b, c, d, e, f, g, h = (" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(8))
    keep = [(1, a), (None, b), (None, c), (7, d), (7, e), (2, f), (8, g), (9, h), (None, ""), (None, ""), (9, None)]
    drop = [(None, a), (None, a + " end"), (None, b), (None, b), (8, f), (9, h), (9, h)]
    got = [tuple(r) for r in J.keep_one(spark.createDataFrame(keep + drop, "doc_id bigint, text string")).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=order) == sorted(keep, key=order)


def test_only_texts_of_wanted_hashes_are_cut_again(spark):
    texts = ["one two three four five six", "ONE two three four five six", "seven eight nine ten eleven", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = spark.createDataFrame([(t,) for t in texts[:3]], "text string").selectExpr("xxhash64(text) h").collect()
    nodes = [J.node_of(J.shingle_set(t)) for t in texts[:3]]
    assert nodes[0] == nodes[1]
    # the hash says which texts are read, whatever the node beside it
    wanted = spark.createDataFrame([(nodes[0], hashes[2]["h"])], "node long, h long")
    assert [r["node"] for r in J._node_sets(docs, wanted, J.WIDTH).collect()] == [nodes[2]]
    wanted = spark.createDataFrame([(nodes[0], hashes[0]["h"]), (nodes[0], hashes[1]["h"])], "node long, h long")
    found = J._node_sets(docs, wanted, J.WIDTH).collect()
    assert [(r["node"], bytes(r["hashes"])) for r in found] == [(nodes[0], J.shingle_set(texts[0]).tobytes())]
