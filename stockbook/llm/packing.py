"""Bulk-synchronous best-fit packing of documents into sequences.

Documents become token ids plus an end id; only those longer than the
capacity are cut (a shorter first piece, then full pieces). Full pieces are
sequences of their own. All others are matched to sequences in rounds:

1. the sizes still unplaced are counted (at most ``capacity`` distinct ones);
   every gap looks up the largest such size it can hold;
2. documents (by size) and gaps (by that size) are sorted together into
   ranges; a random second key spreads a size that holds many rows. Of the
   gaps of a size only about twice as many are dealt as there are documents
   that could go there; the others wait;
3. each range is swept upwards: documents stack up, and every gap takes the
   largest document below it that fits, then what else fits beside it. A
   document goes to the first gap in sort rank that reaches it, so no two
   gaps ever take the same document;
4. gaps shrink, what was not placed stays for the next round. After a round
   of one range that dealt every gap nothing left fits any gap; then, or when a
   round places next to nothing, the volume left opens new sequences, seeded by
   the largest documents. An opening places at least one document, so the rounds end.

Each round is written to the shared folder. The driver reads the histogram of
sizes, which ``capacity`` bounds, and ``SEED_BUCKETS`` counts, nothing per
document. A task holds about ``rows_per_range`` rows, gaps included.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import id_text, ship, stage, table

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ROUND = "kind int, id bigint, size int, bin bigint, offset int"
DOC, BIN, PLACED = 0, 1, 2
SEED_BUCKETS = 1 << 16


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n_ids`` ids: one piece up to the
    capacity, else a remainder (if any) followed by full pieces."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n_ids, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
           vocabulary: str | None = None) -> DataFrame:
    """One row per piece, with the checksum of its ids and a row ``id``."""
    path = vocabulary or tokens.vocabulary_path()
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                packed = encoder.packed(text) + end
                for k, (s, n) in enumerate(cut(len(packed) // 4, capacity)):
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(packed[4 * s:4 * (s + n)]))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    out = id_text(docs).mapInArrow(encode, _PIECES).withColumn("id", F.monotonically_increasing_id())
    return stage(out, "pieces")


def _sweep(capacity: int):
    """One range: rows sorted by key, documents before gaps."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []       # unplaced documents, ascending
        ids: list[int] = []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            rows = zip(kinds, batch.column("id").to_pylist(), batch.column("size").to_pylist(),
                       batch.column("key").to_pylist(), strict=True)
            out: list[tuple[int, int, int, int | None, int | None]] = []
            for kind, rid, size, _key in rows:
                if kind == DOC:
                    sizes.append(size)
                    ids.append(rid)
                    continue
                gap = size
                while sizes and sizes[0] <= gap:
                    at = bisect_right(sizes, gap) - 1
                    took = sizes.pop(at)
                    out.append((PLACED, ids.pop(at), took, rid, capacity - gap))
                    gap -= took
                out.append((BIN, rid, gap, None, None))
            if out:
                yield _round_batch(out)
        if sizes:
            yield _round_batch([(DOC, i, s, None, None) for s, i in zip(sizes, ids, strict=True)])

    return sweep


def _round_batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, rid, size, bin_, offset = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(kind, pa.int32()), pa.array(rid, pa.int64()), pa.array(size, pa.int32()),
         pa.array(bin_, pa.int64()), pa.array(offset, pa.int32())],
        names=["kind", "id", "size", "bin", "offset"])


def _histogram(rows: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of unplaced documents and of gaps by size (index 0..capacity)."""
    counts = np.zeros((2, capacity + 1), dtype=np.int64)
    for r in rows.where(F.col("kind") != PLACED).groupBy("kind", "size").count().collect():
        counts[r["kind"], r["size"]] = r["count"]
    return counts[DOC], counts[BIN]


def _seeds(counts: np.ndarray, n: int) -> tuple[int, int]:
    """(size, number): all documents above ``size`` and that number of those of
    ``size`` are the ``n`` largest documents."""
    above = 0
    for size in range(len(counts) - 1, 0, -1):
        if above + counts[size] >= n:
            return size, n - above
        above += int(counts[size])
    return 0, 0


def _open(rows: DataFrame, counts: np.ndarray, n: int, capacity: int) -> DataFrame:
    """Open new sequences with the ``n`` >= 1 largest unplaced documents. Of
    the smallest size among them whole hash buckets are taken until there are
    enough, so never none."""
    rows = rows.where(F.col("kind") != PLACED)
    size, number = _seeds(counts, n)
    bucket = F.pmod(F.xxhash64("id"), F.lit(SEED_BUCKETS))
    last = SEED_BUCKETS
    if 0 < number < counts[size]:
        held = (rows.where((F.col("kind") == DOC) & (F.col("size") == size)).groupBy(bucket.alias("bucket")).count()
                .orderBy("bucket").collect())
        last = held[int(np.searchsorted(np.cumsum([r["count"] for r in held]), number))]["bucket"]
    seed = (F.col("kind") == DOC) & ((F.col("size") > size) | ((F.col("size") == size) & (bucket <= last)))
    seeds = rows.where(seed)
    placed = seeds.select(F.lit(PLACED).alias("kind"), "id", "size", F.col("id").alias("bin"),
                          F.lit(0).alias("offset"))
    bins = seeds.select(F.lit(BIN).alias("kind"), "id", (F.lit(capacity) - F.col("size")).alias("size"),
                        F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("offset"))
    return rows.where(~seed).unionByName(placed).unionByName(bins)


def _by_size(values: np.ndarray):
    """A column's look-up in one value per size."""
    return F.get(F.array(*[F.lit(x) for x in values.tolist()]), F.col("size"))


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows_per_range: int = 100_000) -> DataFrame:
    """``(id, bin, offset)`` for items ``(id bigint, size int)`` with unique
    ids and sizes 1..capacity; ``bin`` is the id of a bin's first item. Each
    item is returned once."""
    ship(items.sparkSession)
    rows = items.select(F.lit(DOC).alias("kind"), "id", "size", F.lit(None).cast("bigint").alias("bin"),
                        F.lit(None).cast("int").alias("offset"))
    counts, gaps = _histogram(rows, capacity)
    all_sizes = np.arange(capacity + 1)
    done: list[DataFrame] = []

    def volume() -> int:
        return -(-int((counts * all_sizes).sum()) // capacity)

    opening = max(int(counts[capacity // 2 + 1:].sum()), volume())
    number = 0
    while counts.sum():
        number += 1
        if opening:
            before = counts.sum()
            rows = stage(_open(rows, counts, opening, capacity), "opened")
            done.append(rows.where(F.col("kind") == PLACED).select("id", "bin", "offset"))
            counts, gaps = _histogram(rows, capacity)
            if counts.sum() >= before:
                raise RuntimeError("an opening placed no document")
            if not counts.sum():
                break
        before = int(counts.sum())
        present = np.flatnonzero(counts)
        # the largest unplaced size that each gap can hold (0: none)
        at = np.searchsorted(present, all_sizes, side="right")
        reach = np.where(at > 0, present[at - 1], 0)
        # of the gaps that reach a size, about twice as many as documents can use
        usable = np.bincount(reach, gaps, capacity + 1)
        usable[0] = 0
        share = np.minimum(1.0, (2 * np.cumsum(counts) + 64) / np.maximum(usable, 1))[reach]
        drawn = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(1 << 30)) < _by_size(share) * F.lit(1 << 30)
        live = rows.where((F.col("kind") == DOC) | ((F.col("kind") == BIN) & (F.col("size") >= int(present[0]))))
        dealt = live.where((F.col("kind") == DOC) | drawn)
        keyed = (dealt.withColumn("key", F.when(F.col("kind") == DOC, F.col("size")).otherwise(_by_size(reach)))
                 .withColumn("spread", F.xxhash64("id", "kind")))
        all_gaps = bool((share[all_sizes >= present[0]] >= 1).all())
        expected = before + int((gaps * share * (reach > 0)).sum())
        ranges = -(-expected // rows_per_range)
        # what one task may hold is swept by one task
        dealt = keyed.repartitionByRange(ranges, "key", "spread") if ranges > 1 else keyed.coalesce(1)
        swept = (dealt.sortWithinPartitions("key", "kind", "size", "spread")
                 .select("kind", "id", "size", "key").mapInArrow(_sweep(capacity), _ROUND))
        if not all_gaps:
            swept = swept.unionByName(live.where((F.col("kind") == BIN) & ~drawn))
        rows = stage(swept, "round")
        done.append(rows.where(F.col("kind") == PLACED).select("id", "bin", "offset"))
        counts, gaps = _histogram(rows, capacity)
        opening = 0
        if (ranges == 1 and all_gaps) or before - int(counts.sum()) < 0.05 * before:
            opening = volume()
    out = done[0] if done else rows.select("id", "bin", "offset")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         vocabulary: str | None = None) -> DataFrame:
    """Place every piece of every document.

    Returns ``(doc_id, piece, start, length, ids_crc32, sequence_id,
    offset)``. A null text is an empty text (its end id alone); a null
    ``doc_id`` stays null; repeated rows are packed once each; other columns
    are ignored; an empty table gives no rows.
    """
    all_pieces = pieces(docs, capacity, end_id, vocabulary)
    small = all_pieces.where(F.col("length") < capacity)
    placed = best_fit(small.select("id", F.col("length").cast("int").alias("size")), capacity)
    joined = all_pieces.join(placed, "id", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32",
                         F.coalesce("bin", "id").alias("sequence_id"),
                         F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
