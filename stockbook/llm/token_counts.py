"""Token counts per document by a map-side two-tier lookup.

1. Every task summarises the pre-tokens of its documents as one row: at most
   ``per_task`` of the most frequent ones with their counts. These rows are
   merged in a tree, ``FAN_IN`` to one, each merge bounded alike, until the
   driver can merge the last few. No pre-token is a shuffle key. The
   ``table_size`` most frequent ones of the result, with their token counts, are
   broadcast as one compact table.
2. Every document is counted in one pass: pre-token lengths come from the
   table, else from the worker's own cache, else from the tokenizer.

The table only saves work: the counts are those of ``tokenizers`` whatever it
holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import id_text, stage, table

PER_TASK = 16_384
TABLE_SIZE = 65_536
MAX_KEPT = 400_000
FAN_IN = 16


_SUMMARY = "pretokens array<string>, counts array<bigint>"


def _summary(counts: Counter, size: int) -> pa.RecordBatch:
    top = counts.most_common(size)
    return pa.record_batch([pa.array([[p for p, _ in top]], pa.list_(pa.string())),
                            pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["pretokens", "counts"])


def _merge(rows: Iterator[tuple[list[str], list[int]]]) -> Counter:
    counts: Counter = Counter()
    for pretokens, numbers in rows:
        for p, n in zip(pretokens, numbers, strict=True):
            counts[p] += n
        if len(counts) > MAX_KEPT:  # keep the frequent half of a full summary
            counts = Counter(dict(counts.most_common(MAX_KEPT // 2)))
    return counts


def frequent_pretokens(docs: DataFrame, per_task: int = PER_TASK, table_size: int = TABLE_SIZE,
                       vocabulary: str | None = None) -> list[str]:
    """The most frequent pre-tokens of all texts, from bounded summaries."""
    path = vocabulary or tokens.vocabulary_path()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = tokens.encoder(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(encoder.pretokens(text) or ())
                if len(counts) > MAX_KEPT:
                    counts = Counter(dict(counts.most_common(MAX_KEPT // 2)))
        yield _summary(counts, per_task)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("pretokens").to_pylist(), b.column("counts").to_pylist(), strict=True))
        yield _summary(_merge(rows), per_task)

    summaries = stage(id_text(docs).select("text").mapInArrow(summarise, _SUMMARY), "summaries")
    while (n := summaries.count()) > FAN_IN:
        # whole summaries are dealt round, a merge holds FAN_IN of them one after the other
        summaries = stage(summaries.repartition(-(-n // FAN_IN)).mapInArrow(merge, _SUMMARY), "summaries")
    rows = summaries.collect()          # at most FAN_IN summaries
    merged = _merge((r["pretokens"], r["counts"]) for r in rows)
    return [p for p, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:table_size]]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024,
                 per_task: int = PER_TASK, table_size: int = TABLE_SIZE) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` stays
    null; repeated rows are counted once each; other columns are ignored.
    """
    path = vocabulary or tokens.vocabulary_path()
    spark = docs.sparkSession
    enc = tokens.Encoder(path, 1)
    frequent = {p: len(enc.pretoken(p)) for p in frequent_pretokens(docs, per_task, table_size, path)}
    lengths = spark.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        first, second = lengths.value, encoder.lengths

        def n_tokens(text: str) -> int:
            pretokens = encoder.pretokens(text)
            if pretokens is None:
                return len(encoder.whole(text))
            return sum([first[p] if p in first else second[p] for p in pretokens])

        for batch in batches:
            n = [n_tokens(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                  names=["doc_id", "n_bytes", "n_tokens"])

    counted = (id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
               .mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"))
