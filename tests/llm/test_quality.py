import zlib

import numpy as np

from conftest import SF01
from stockbook.llm import quality as Q

from . import fixtures


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.score(docs, Q.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    known = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good = np.array([g["score"] for g, q in known if q == 1])
    bad = np.array([g["score"] for g, q in known if q == 0])
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert np.mean([g["predicted"] == q for g, q in known]) > 0.9


def test_hard_rows_and_few_labels(spark):
    docs = fixtures.hard_docs(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, labels, epochs=2)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(fixtures.hard_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    for few in (labels.where("quality = 1"), labels.limit(0)):
        constant = Q.score(docs, Q.fit(docs, few, epochs=1)).collect()
        assert len({r["score"] for r in constant}) == 1
    assert Q.score(fixtures.no_docs(spark), model).count() == 0
    assert Q.keep_good(fixtures.no_docs(spark), model).count() == 0


def test_training_sample_is_bounded_and_leaves_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    ids = [r["doc_id"] for r in Q.training_sample(docs, labels, 50).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
