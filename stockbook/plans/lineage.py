"""Cutting lineage in iterative jobs.

Reliable checkpoints go to the shared folder named by ``spark.checkpoint.dir``
(``session.checkpoint_dir``), so a lost executor never loses a materialised
step. Local checkpoints are never used.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the re-read plan."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and return the
    re-read table: like ``cut_lineage``, for wide rows of which later steps
    read few columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a result that several later steps read (memory, spilling to
    disk). Only for results whose lineage is shallow and starts at a
    checkpoint or at the input tables: a lost block is recomputed from there,
    and the recomputation gives the same rows."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


#: What ``reuse`` keeps in memory until ``release``.
_kept: list[DataFrame] = []


def release() -> None:
    """Drop the results that ``reuse`` kept so far (they only save
    recomputation). Tables a user cached are not touched."""
    while _kept:
        _kept.pop().unpersist()
