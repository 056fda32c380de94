"""Packed token-id matrices by best-fit decreasing.

Texts become token ids plus an end id. Documents longer than the width are cut
into full pieces and a shorter last one, losing nothing. Inside a shard (a run
of documents of one input split, at most ``shard_tokens`` tokens, which bounds
a task's memory) pieces are placed from the longest to the shortest, each into
the row with the least free space that still holds it; a segment tree over free
space finds that row. A row of the result is one matrix row:

- ``ids``: ``width`` little-endian ids (2 bytes each where the vocabulary
  allows, else 4), filled up with ``pad_id``;
- ``cu_seqlens``: 0 and the end column of each segment;
- ``position_resets``: the columns where positions start again at 0 (every
  segment, and the filling);
- ``doc_ids``, ``starts``: for each segment its document and its first id's
  place there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import id_text, scratch, table

WIDTH = 2048
END_ID = 50256
SHARD_TOKENS = 4_000_000

_ROWS = ("n_tokens int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
         "position_resets array<int>, ids binary")


class CapacityTree:
    """How many rows have each amount of free space, as a segment tree that
    finds the least amount of at least some size that any row has."""

    def __init__(self, most: int):
        self._leaves = 1 << most.bit_length()
        self._count = [0] * (2 * self._leaves)

    def add(self, free: int, n: int = 1) -> None:
        at = free + self._leaves
        while at:
            self._count[at] += n
            at >>= 1

    def at_least(self, size: int) -> int | None:
        at = size + self._leaves
        if self._count[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self._count[at + 1]:     # the next subtree to the right
                at += 1
                while at < self._leaves:
                    at = 2 * at if self._count[2 * at] else 2 * at + 1
                return at - self._leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers; items of one size keep their order."""
    tree, free_rows = CapacityTree(width), [[] for _ in range(width + 1)]
    rows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.at_least(sizes[i])
        if free is None:
            row, free = len(rows), width
            rows.append([])
        else:
            row = free_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(i)
        left = free - sizes[i]
        free_rows[left].append(row)
        tree.add(left)
    return rows


def pack_matrices(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, pad_id: int = END_ID,
                  vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The matrix rows of all texts.

    A null text is an empty text (its end id alone); a null doc_id stays null;
    repeated rows are packed once each; other columns are ignored; an empty
    table gives no rows. The filling is told from ids by ``n_tokens``.
    """
    path = vocabulary or tokens.vocabulary_path()
    names = [c.split()[0] for c in _ROWS.split(", ")]
    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        kind = np.dtype("<u2") if max(encoder.size, end_id + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")
        ids, owner, start, total = [], [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            out = []
            for members in best_fit_decreasing([len(x) for x in ids], width):
                ends = np.cumsum([len(ids[i]) for i in members])
                row = np.full(width, pad_id, kind)
                row[:ends[-1]] = np.concatenate([ids[i] for i in members])
                resets = [0, *ends.tolist()]
                out.append((int(ends[-1]), [owner[i] for i in members], [start[i] for i in members], resets,
                            [c for c in resets if c < width], row.tobytes()))
            for at in range(0, len(out), 500):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[at:at + 500], strict=True), types,
                                                                      strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = np.append(np.frombuffer(encoder.packed(text), "<u4"), end_id).astype(kind)
                for at in range(0, len(got), width):
                    ids.append(got[at:at + width])
                    owner.append(doc)
                    start.append(at)
                total += len(got)
                if total >= shard_tokens:
                    yield from rows()
                    ids, owner, start, total = [], [], [], 0
        if ids:
            yield from rows()

    return id_text(docs).mapInArrow(run, _ROWS)


def write_matrices(rows: DataFrame, path: str) -> DataFrame:
    """Write the rows as Parquet files below ``path`` with a number per row,
    ``sequence_id``, and return the written table."""
    numbered = rows.select(F.monotonically_increasing_id().alias("sequence_id"), "*")
    numbered.write.parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


def segments(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, start, length, ids)`` of every segment, ``ids`` as stored:
    the inverse of packing (a document is its segments in order of start)."""
    size = F.octet_length("ids") / F.lit(width)
    parts = rows.select("ids", size.cast("int").alias("size"), F.explode(F.arrays_zip(
        "doc_ids", "starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("a"),
        F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("b"))).alias("s"))
    length = F.col("s.b") - F.col("s.a")
    return parts.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), length.alias("length"),
                        F.substring(F.col("ids"), F.col("s.a") * F.col("size") + 1, length * F.col("size")).alias("ids"))


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as packed matrices, written and read back."""
    rows = pack_matrices(table(spark, sf_dir, "documents"))
    return write_matrices(rows, f"{scratch(spark)}/matrices")
