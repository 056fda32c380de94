import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from conftest import SF001
from stockbook.llm import mixing, packing
from stockbook.llm import tokens as T

from . import fixtures, test_line_dedup, test_mixing, test_shingle_join


def test_stages_on_hard_rows(spark):
    docs = fixtures.hard_docs(spark)
    for name, stage in P.STAGES[1:]:
        out = P.stage(stage(spark, docs, SF001), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.count() > 0, name
        docs = out
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def check_packed(rows, texts, capacity=2048):
    """Every copy of every document whole, each place once, no gaps."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(T.vocabulary_path())
    want = Counter()
    for doc_id, text, copies in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[doc_id, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += copies
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert max(places.values()) == 1
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= capacity
    return len(end)


def test_stages_against_brute_force(spark):
    """Each stage's result from its own input, by the plain versions."""
    rng = random.Random(6)
    lines = [fixtures.sentence(rng, rng.randint(5, 12)) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.3 else fixtures.sentence(rng, rng.randint(5, 30))
                       for _ in range(rng.randint(1, 12))) for _ in range(50)]
    texts += [texts[i] + f"\nadded line {i} that no other has" for i in range(8)] + [texts[3], None, "", "one"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(P.STAGES)

    def run(name, docs):
        return P.stage(stages[name](spark, docs, SF001), name)

    by_id = lambda rs: sorted((r[0], r[1]) for r in rs)
    key = lambda r: (r[0], r[1] is None, r[1] or "")
    deduped = run("line_dedup", docs)
    got = deduped.collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=key) == sorted(test_line_dedup.brute([r[:2] for r in rows]), key=key)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    kept = run("ngram_jaccard_join", deduped)
    sets = test_shingle_join.brute([(r["doc_id"], r["text"]) for r in got])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in sets if i == c)
    held = kept.collect()
    mixed = run("entropy_mixing", kept)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in held}
    words, taken = Counter(), Counter()
    for r in held:
        words[r["source"]] += size[r["doc_id"]]
        taken[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    targets = test_mixing.brute_targets(words)
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in words) and max(copies.values()) <= 2
    assert {r["doc_id"]: (r["text"], r["source"]) for r in mixed.collect()}.items() <= \
        {r["doc_id"]: (r["text"], r["source"]) for r in held}.items()
    packed = run("best_fit_packing", mixed).collect()
    n = check_packed(packed, [(r["doc_id"], r["text"], copies[r["doc_id"]]) for r in held if copies[r["doc_id"]]])
    assert n <= -(-sum(r["length"] for r in packed) // 2048) + 1
    assert by_id(deduped.select("doc_id", "lang").collect()) == by_id(docs.select("doc_id", "lang").collect())


def test_whole_run(spark):
    rows = P.run(spark, SF001).collect()
    ids = {r["doc_id"] for r in rows}
    assert 100 < len(ids) <= 200 and max(r["length"] for r in rows) <= 2048
    assert max(Counter((r["sequence_id"], r["offset"]) for r in rows).values()) == 1
    copies = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert max(copies.values()) <= mixing.MOST


def test_empty_table_through_all_stages(spark):
    docs = fixtures.no_docs(spark)
    for _name, stage in P.STAGES[1:]:
        docs = stage(spark, docs, SF001)
    assert docs.count() == 0
