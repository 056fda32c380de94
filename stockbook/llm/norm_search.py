"""Exact ranked search by norm buckets over impact vectors (LEMP).

A document is a vector of impacts, one coordinate per term; a query is a vector
of term weights times counts; the score is their inner product, in integers.
Queries come in blocks whose terms have a stated bound. For a block:

1. one scan of the texts keeps, of each document, its length and the terms
   that the block asks for; document frequencies are summed from these, the
   number of documents and their lengths over all documents;
2. documents become vectors over the block's terms. They are ordered by length
   (Euclidean norm), longest first, by a range sort, and written;
3. the vectors are searched in waves of falling norm. A task takes its vectors
   in buckets of ``BUCKET`` rows. By Cauchy-Schwarz no score in a bucket passes
   the query's norm times the bucket's largest: a query whose k-th best score so
   far is above that skips the bucket, and a wave that all queries skip
   ends the search;
4. inside a bucket the query's largest coordinates are the focus: so many that
   a document without any of them is below the k-th best score by
   Cauchy-Schwarz on the rest. Documents that have some are bounded by the
   product over the focus coordinates plus the norms of what both sides have
   left; only those whose bound reaches the k-th best score survive;
5. survivors are scored again, over all their terms, in 64-bit integers. The
   best of a task enter the best of the query, whose k-th score is the next
   wave's threshold.

Bounds are computed in doubles and widened by far more than their rounding;
they never decide an order. A document is kept at equal scores too, as ties are
broken by doc_id.

The driver holds a block's terms and one threshold per query of it, both
bounded by ``BLOCK_TERMS``, and nothing per document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, stage, table
from .query_blocks import BLOCK_TERMS, Block, blocks_of, queries, ranges, read_block

TOP = 10
BUCKET = 4096
WAVES = (1 / 64, 1 / 8)      # shares of the rows, longest vectors first; the rest is the last wave
VECTORS_PER_RANGE = 20_000
SLACK = 1 + 1e-9             # beyond the rounding of sums of a few thousand doubles
# Bytes that are not part of a term, A-Z in lower case.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_KEPT = "row bigint, doc_id bigint, n bigint, terms array<int>, counts array<int>"
_VECTORS = "row bigint, doc_id bigint, norm double, terms array<int>, impacts array<bigint>"
_FOUND = "query bigint, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def kept_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """Staged ``(row, doc_id, n, terms, counts)`` of all documents: how many
    terms they have, and which of the broadcast ``vocabulary`` how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                held = Counter(words)
                both = held.keys() & numbers.keys() if len(held) < len(numbers) else [t for t in numbers if t in held]
                lengths.append(len(words))
                terms.append([numbers[t] for t in both])
                counts.append([held[t] for t in both])
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(lengths, pa.int64()),
                                   pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                                  names=["row", "doc_id", "n", "terms", "counts"])

    rows = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stage(rows.mapInArrow(run, _KEPT), "kept")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes of the rows' lists)."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def vectors(kept: DataFrame, n_docs: int, total: int, rows_per_range: int = VECTORS_PER_RANGE) -> DataFrame:
    """Staged impact vectors of the documents with a kept term, longest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, sizes = _flat(batch.column("counts"))
            n = batch.column("n").to_numpy()
            m = 25 + 75 * n * n_docs // total
            tf = tf.astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            of = np.repeat(np.arange(len(n)), sizes)
            norm = np.sqrt(np.bincount(of, impact.astype(float) ** 2, len(n)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(norm), batch.column("terms"),
                                   pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int64()))],
                                  names=["row", "doc_id", "norm", "terms", "impacts"])

    held = kept.where(F.size("terms") > 0)
    ranges = max(1, -(-held.count() // rows_per_range))
    made = held.mapInArrow(run, _VECTORS)
    # equal norms (copies) are spread by the row number
    sorted_ = (made.repartitionByRange(ranges, F.desc("norm"), F.xxhash64("row")) if ranges > 1 else made.coalesce(1))
    return stage(sorted_.sortWithinPartitions(F.desc("norm"), "row"), "vectors")


class Searcher:
    """A task's search: buckets in, the best documents of each query out."""

    def __init__(self, block: Block, weights: np.ndarray, least: np.ndarray, top: int):
        self._block, self._top, self._least = block, top, least.copy()
        self._weights = weights
        self._best: list[list[tuple]] = [[] for _ in block.queries]
        self._dense = np.zeros(len(weights), np.int64)
        self._plans = []
        for q in range(len(block.queries)):
            at = slice(block.starts[q], block.starts[q + 1])
            value = block.counts[at] * weights[block.terms[at]]
            order = np.argsort(-value, kind="stable")
            value, terms = value[order], block.terms[at][order]
            rest = np.sqrt(np.concatenate([np.cumsum((value.astype(float) ** 2)[::-1])[::-1], [0.0]]))
            self._plans.append((terms, value, rest))
        self._norms = np.array([p[2][0] for p in self._plans])
        self.skipped = self.scored = 0

    def bucket(self, doc_ids: list, norms: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray) -> None:
        n = len(norms)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(terms, kind="stable")
        docs = np.repeat(np.arange(n), sizes)[order]
        parts, by = impacts[order].astype(float), terms[order]
        present, first = np.unique(by, return_index=True)
        ends = np.append(first[1:], len(by))
        largest = norms.max()
        active = self._norms * largest * SLACK >= self._least
        self.skipped += int((~active).sum())
        for q in np.flatnonzero(active):
            self._query(q, n, docs, parts, present, first, ends, largest, norms, doc_ids, starts, terms, impacts)

    def _query(self, q, n, docs, parts, present, first, ends, largest, norms, doc_ids, starts, terms, impacts) -> None:
        least = self._least[q]
        q_terms, value, rest = self._plans[q]
        # the smallest focus without whose coordinates no document reaches the threshold
        focus = int(np.argmax(rest * largest * SLACK < max(least, 1)))
        at = np.searchsorted(present, q_terms[:focus])
        at = np.where(at < len(present), at, 0)
        held = np.flatnonzero(present[at] == q_terms[:focus]) if len(present) else []
        if not len(held):
            return
        runs = [slice(first[at[i]], ends[at[i]]) for i in held]
        of = np.concatenate([docs[r] for r in runs])
        x = np.concatenate([parts[r] for r in runs])
        product = np.bincount(of, x * np.repeat(value[held].astype(float), [r.stop - r.start for r in runs]), n)
        left = np.sqrt(np.maximum(norms ** 2 - np.bincount(of, x * x, n), 0) + norms ** 2 * 1e-12)
        near = np.flatnonzero((product > 0) & ((product + rest[focus] * left) * SLACK >= least))
        if not len(near):
            return
        self.scored += len(near)
        self._dense[q_terms] = value
        sizes = starts[near + 1] - starts[near]
        places = ranges(starts[near], sizes)
        score = np.add.reduceat(self._dense[terms[places]] * impacts[places], np.cumsum(sizes) - sizes)
        self._dense[q_terms] = 0
        keep = (score >= max(least, 1)).nonzero()[0]
        if len(keep) > self._top:       # only the bucket's own best can enter, with their ties
            keep = keep[score[keep] >= np.partition(score[keep], len(keep) - self._top)[len(keep) - self._top]]
        new = [(-int(score[i]), doc_ids[near[i]] is None, doc_ids[near[i]] or 0) for i in keep]
        self._best[q] = best = sorted(self._best[q] + new)[:self._top]
        if len(best) == self._top:
            self._least[q] = max(least, -best[-1][0])

    def results(self) -> Iterator[tuple[int, int | None, int]]:
        for q, best in zip(self._block.queries.tolist(), self._best, strict=True):
            for negative, null, doc_id in best:
                yield q, None if null else doc_id, -negative


def _wave(rows: DataFrame, shared, bucket: int, top: int) -> DataFrame:
    """``(query, doc_id, score)``: every task's best above the thresholds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for whole in batches:
            for start in range(0, whole.num_rows, bucket):
                batch = whole.slice(start, bucket)
                searcher = searcher or Searcher(*shared.value, top)
                terms, sizes = _flat(batch.column("terms"))
                impacts, _ = _flat(batch.column("impacts"))
                searcher.bucket(batch.column("doc_id").to_pylist(), batch.column("norm").to_numpy(),
                                terms.astype(np.int64), impacts, sizes)
        found = list(searcher.results()) if searcher else []
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return rows.select("doc_id", "norm", "terms", "impacts").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(kept: DataFrame, block: Block, n_docs: int, total: int, top: int, bucket: int,
                  rows_per_range: int) -> DataFrame:
    """Staged ``(query, rank, doc_id, score)`` of a block."""
    spark = kept.sparkSession
    weights = np.zeros(len(block.vocabulary), np.int64)
    for r in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():   # at most the vocabulary
        weights[r["term"]] = weight(n_docs, r["count"])
    rows = vectors(kept, n_docs, total, rows_per_range)
    least = np.zeros(len(block.queries), np.int64)
    place = {q: i for i, q in enumerate(block.queries.tolist())}
    norms = np.sqrt(np.add.reduceat((block.counts * weights[block.terms]).astype(float) ** 2, block.starts[:-1]))
    cuts = rows.agg(F.percentile_approx("norm", [1 - s for s in WAVES], 10_000)).first()[0] or []
    best = None
    for low, high in zip([*cuts, 0.0], [None, *cuts], strict=True):
        if high is not None and not (norms * high * SLACK >= least).any():
            break
        part = rows.where(F.col("norm") >= low)
        part = part if high is None else part.where(F.col("norm") < high)
        shared = spark.sparkContext.broadcast((block, weights, least))
        found = _wave(part, shared, bucket, top)
        best = stage(_ranked(found if best is None else found.unionByName(best.drop("rank")), top), "best")
        # one number per query of the block
        for r in best.where(F.col("rank") == top).select("query", "score").collect():
            least[place[r["query"]]] = r["score"]
    return best


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS,
                  bucket: int = BUCKET, rows_per_range: int = VECTORS_PER_RANGE) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents of
    largest score above 0, equal scores by doc_id (null last).

    ``docs`` has (doc_id, text), ``items`` (item_id, text); other columns are
    ignored. A null or empty text has no terms: such a document is never found
    and does not count, such an item finds nothing. Repeated rows of ``docs``
    count and are found once each; equal rows of ``items`` are one, rows that
    share an item_id (also null) but not the text are searched each for itself
    and ranked together, by their score and doc_id. Empty tables give no rows.
    """
    asked = queries(items, "item_id", terms_of)
    n_blocks = blocks_of(asked, block_terms)
    out, statistics = None, None
    for b in range(n_blocks):
        block = read_block(asked, n_blocks, b)                           # at most block_terms terms
        if not len(block.queries):
            continue
        kept = kept_terms(docs, docs.sparkSession.sparkContext.broadcast(block.vocabulary))
        if statistics is None:
            statistics = kept.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, total = statistics
        if not total:
            break
        found = _search_block(kept, block, n_docs, total, top, bucket, rows_per_range)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"),
                            F.lit(0).cast("bigint").alias("score")).where(F.lit(False))
    named = out.join(asked.select("query", "item_id"), "query").select("item_id", "doc_id", "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def op11_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``documents`` for every item of ``benchmark``."""
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same ranking by scoring every document that shares a term.
OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') AS w
               FROM documents),
held AS (SELECT row, doc_id, len(w) AS n, w FROM words WHERE len(w) > 0),
size AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_docs, CAST(SUM(n) AS BIGINT) AS total FROM held),
tf AS (SELECT row, doc_id, n, term, COUNT(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM held) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
           FROM tf, size GROUP BY term, n_docs),
asked AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) AS term FROM benchmark),
scores AS (SELECT a.item_id, tf.row, tf.doc_id,
                  CAST(SUM(weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * n_docs) // total))))
                       AS BIGINT) AS score
           FROM asked a JOIN tf ON tf.term = a.term JOIN weight ON weight.term = a.term, size
           GROUP BY a.item_id, tf.row, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
