import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from stockbook.llm import common, packing, quality, query_blocks, search, tokens

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(docs):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    return docs.mapInArrow(sizes, "n bigint, bytes bigint")


def long_texts(spark, n=900, chars=20_000):
    return spark.range(0, n, 1, 1).selectExpr("id as doc_id", f"rpad(cast(id as string), {chars}, ' word') as text")


def test_staged_batches_are_bounded_in_bytes(spark):
    before = spark.conf.get(_KEY)
    rows = common.stage(batch_sizes(long_texts(spark))).collect()
    assert sum(r["n"] for r in rows) == 900
    assert max(r["bytes"] for r in rows) < 2 * common.BATCH_BYTES
    assert spark.conf.get(_KEY) == before


def test_one_row_above_the_bound_goes_alone(spark):
    docs = long_texts(spark, 3, common.BATCH_BYTES + 10)
    assert [r["n"] for r in common.stage(batch_sizes(docs)).collect()] == [1, 1, 1]


def test_the_setting_comes_back(spark):
    spark.conf.set(_KEY, "5m")
    try:
        with pytest.raises(ZeroDivisionError), common.small_batches(spark):
            assert int(spark.conf.get(_KEY)) == common.BATCH_BYTES
            1 / 0
        assert spark.conf.get(_KEY) == "5m"
    finally:
        spark.conf.unset(_KEY)


def test_pieces_of_many_batches(spark):
    docs = long_texts(spark, 250, 20_000)        # 5 MB in one partition
    got = sorted((r["doc_id"], r["start"], r["length"]) for r in packing.pieces(docs).collect())
    encoder, want = tokens.Encoder(tokens.vocabulary_path()), []
    for r in docs.collect():
        n = len(encoder.whole(r["text"])) + 1
        want += [(r["doc_id"], s, k) for s, k in packing.cut(n)]
    assert got == sorted(want)


def test_kept_rows_of_many_slices(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_ROWS", 7)
    docs = spark.range(0, 60, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id % 9, ' '), int(id)) as text")
    labels = spark.range(0, 60).selectExpr("id as doc_id", "int(id % 2) as quality")
    model = quality.fit(docs, labels, epochs=2)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    middle = sorted(scores.values())[30] - 1e-9
    got = [r["doc_id"] for r in quality.keep_good(docs, model, middle).collect()]
    assert got == [d for d in range(60) if scores[d] >= middle]
    assert 7 < len(got) < 60


def test_a_block_is_read_as_flat_arrays(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 9000}" for j in range(400))) for i in range(0, 400)] + [(400, "a b a"), (401, "")]
    asked = query_blocks.queries(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", search.words_of)
    ids, texts = {r["query"]: r["doc_id"] for r in asked.collect()}, dict(rows)
    n_blocks, got, terms = 3, {}, 0
    for b in range(n_blocks):
        tracemalloc.start()
        block = query_blocks.read_block(asked, n_blocks, b)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 * max(20_000, len(block.terms))
        words = list(block.vocabulary)
        assert list(block.vocabulary.values()) == list(range(len(words)))
        for q, at, to in zip(block.queries.tolist(), block.starts[:-1], block.starts[1:], strict=True):
            got[ids[q]] = {words[t]: c for t, c in zip(block.terms[at:to], block.counts[at:to].tolist(), strict=True)}
        terms += len(block.terms)
    assert got == {d: Counter(search.words_of(t)) for d, t in texts.items() if t}
    assert terms == sum(map(len, got.values()))


def test_an_empty_block(spark):
    asked = query_blocks.queries(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "doc_id", search.words_of)
    blocks = [query_blocks.read_block(asked, 40, b) for b in range(40)]
    assert sorted(len(b.queries) for b in blocks) == [0] * 39 + [1]


def test_scores_and_kept_rows_are_handed_over_in_small_batches(spark):
    """Whatever writes the result, Python is handed no whole split of texts."""
    docs = long_texts(spark, 300, 20_000)          # 6 MB in one partition
    model = quality.fit(docs, spark.range(0, 300).selectExpr("id as doc_id", "int(id % 2) as quality"), epochs=1)
    for result in (quality.keep_good(docs, model, 0.0), quality.score(docs, model)):
        assert "MapInArrow" not in result._jdf.queryExecution().executedPlan().toString()
        assert result.count() == 300
    assert spark.conf.get(_KEY) != str(common.BATCH_BYTES)


def test_words_counted_in_parts_are_summed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(30))) for i in range(40)], "doc_id bigint, text string")
    whole = quality._vocabulary(docs, 1000)
    monkeypatch.setattr(quality, "COUNTED", 1)
    assert list(quality._vocabulary(docs, 1000).items()) == list(whole.items())
    assert len(whole) > 30
