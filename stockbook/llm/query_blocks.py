"""Queries searched together: blocks of bounded size, shipped to every task."""

from __future__ import annotations

from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches, stage

BLOCK_TERMS = 1_000_000      # terms of the queries searched together


def queries(rows: DataFrame, key: str, terms_of) -> DataFrame:
    """Staged ``(query, <key>, terms, counts)``, one row per distinct ``(key,
    text)`` of ``rows`` that has terms; ``query`` numbers them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array([list(c) for c in found], pa.list_(pa.binary())),
                                   pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                                  names=[key, "terms", "counts"])

    ship(rows.sparkSession)
    texts = rows.select(F.col(key).cast("bigint").alias(key), F.col("text").cast("string").alias("text"))
    found = (texts.where("text is not null").distinct()
             .mapInArrow(run, f"{key} bigint, terms array<binary>, counts array<bigint>").where(F.size("terms") > 0))
    return stage(found.select(F.monotonically_increasing_id().alias("query"), key, "terms", "counts"), "queries")


def blocks_of(asked: DataFrame, block_terms: int = BLOCK_TERMS) -> int:
    """How many blocks (by hash of the query) hold at most ``block_terms``
    terms each, a single query with more than that apart."""
    total, largest = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.max(F.size("terms"))).first()
    blocks = max(1, -(-total // block_terms))
    while blocks > 1 or total > block_terms:
        worst = asked.groupBy(block_number(blocks)).agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0]
        if worst <= max(block_terms, largest) or blocks > 16 * total:
            break
        blocks *= 2
    return blocks


def block_number(blocks: int) -> Column:
    return F.pmod(F.xxhash64("query"), F.lit(blocks))


@dataclass
class Block:
    """A block's queries over its own numbering of their terms."""

    queries: np.ndarray
    starts: np.ndarray       # of each query's terms
    terms: np.ndarray
    counts: np.ndarray
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, packed: pa.Table) -> Block:
        """The block of the rows of ``_pack``; terms are numbered as they come."""
        numbers: dict[bytes, int] = {}
        parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for batch in packed.to_batches():
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values.to_pylist()
                place = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                query, sizes, terms, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in _FLAT)
                for part, flat in zip(parts, (query, sizes, place[terms], counts), strict=True):
                    part.append(flat)
        query, sizes, terms, counts = map(np.concatenate, parts)
        return cls(query, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms, counts, numbers)


_FLAT = ["query", "sizes", "terms", "counts"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of queries as one row: flat arrays over its own distinct words."""
    for batch in batches:
        if batch.num_rows:
            terms, counts = batch.column("terms"), batch.column("counts")
            coded = terms.flatten().dictionary_encode()
            flat = [batch.column("query").to_numpy(), np.diff(terms.offsets.to_numpy()), coded.indices.to_numpy(),
                    counts.flatten().to_numpy()]
            words = pa.array([coded.dictionary.to_pylist()], pa.list_(pa.binary()))
            yield pa.record_batch([*(pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in flat), words],
                                  names=[*_FLAT, "words"])


def read_block(asked: DataFrame, blocks: int, number: int) -> Block:
    """Block ``number`` of the staged queries, on the driver. It comes as flat
    arrays; rows of lists would take some 200 bytes a term there."""
    rows = asked.where(block_number(blocks) == number).select("query", "terms", "counts")
    with small_batches(asked.sparkSession):
        return Block.of(rows.mapInArrow(_pack, "query binary, sizes binary, terms binary, counts binary, words array<binary>").toArrow())


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
