import hashlib

import pytest
from pyspark.sql import functions as F

from stockbook.llm import spotsigs as S

from . import fixtures


def brute_signatures(text):
    """Same rule in plain Python: set of (anchor or '', chain...) tuples."""
    import regex
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    anchors = set(S.ANCHORS)
    content = [i for i, w in enumerate(words) if w not in anchors]
    out = set()
    for j, p in enumerate(content):
        after = tuple(words[content[j + k]] if j + k < len(content) else "" for k in range(S.CHAIN))
        first = content[j - 1] + 1 if j else 0
        out |= {(a, *after) for a in words[first:p]}
        if j >= S.STRETCH and p - content[j - S.STRETCH] == S.STRETCH:
            out.add(("", *after))
    if not out and content:
        out = {("", *(words[content[j + k]] if j + k < len(content) else "" for k in range(S.CHAIN)))
               for j in range(len(content))}
    return out or {(w,) for w in words}


def likeness(a, b):
    if not a and not b:
        return 1.0
    v = len(a & b) / len(a | b)
    return v if v >= S.LEAST else 0.0


def test_hard_rows_against_plain_python(spark):
    rows = fixtures.hard_rows()
    got = S.fingerprints(fixtures.hard_docs(spark)).collect()
    assert len(got) == len(rows)
    # order of the chain: ids descending, null last; equal ids by text hash
    hashes = {r["text"]: r["h"] for r in fixtures.hard_docs(spark).select(
        F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    chain = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(chain):
        n = chain[(k + 1) % len(chain)][1]
        c = len(t) // 3
        e = t[:len(t) - c] + n[:c]
        own, changed, after = map(brute_signatures, (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), len(own), len(changed),
                     round(likeness(own, changed), 9), round(likeness(own, after), 9)))
    have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], int(r["fingerprint"].split(":")[0]),
             int(r["edited_fingerprint"].split(":")[0]), round(r["near_edited"], 9), round(r["near_next"], 9))
            for r in got]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(have, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("size", [3, 8])
def test_ranges_do_not_change_the_order(spark, size):
    docs = fixtures.hard_docs(spark)
    whole = {tuple(r) for r in S.with_next(docs).collect()}
    assert {tuple(r) for r in S.with_next(docs, rows_per_range=size).collect()} == whole


def test_single_and_no_rows(spark):
    one = spark.createDataFrame([(1, "the river stone")], "doc_id bigint, text string")
    r = S.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 15
    assert S.fingerprints(fixtures.no_docs(spark)).count() == 0
