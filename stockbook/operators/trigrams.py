"""Contains-search through a posting table of trigrams.

``LIKE '%term%'`` has to read every value. The posting table holds, per distinct
trigram of the lower-cased values, the ids of the rows that have it, one row per
(trigram, id), written sorted by trigram so that a scan for a few trigrams skips
the row groups of all others. A search takes the trigrams of the parts of its
term between wildcards: a matching row has all of them. Rows that do are few;
they are read and checked with the predicate itself, so the result is that of
the scan. A term without a part of three characters (``_`` and ``%`` are
wildcards, as the pages leave them) has no trigram, and is scanned for.

New rows append their postings (``add_postings``); rows whose value changed are
dropped by the check as long as their new trigrams were added, and postings of
deleted rows find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

GRAM = 3
SCHEMA = "gram string, id bigint"


def grams_of(value: Column) -> Column:
    """Distinct trigrams of the lower-cased value."""
    text = F.lower(value)
    last = F.char_length(text) - (GRAM - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def term_grams(term: str) -> list[str]:
    """Trigrams that every value containing ``term`` has: those of the parts
    between wildcards, an escaped wildcard being an ordinary character."""
    parts, part = [], []
    pattern = iter(X.like_pattern(term).lower())
    for ch in pattern:
        if ch == "\\":
            part.append(next(pattern))
        elif ch in "%_":
            parts.append("".join(part))
            part = []
        else:
            part.append(ch)
    parts.append("".join(part))
    return sorted({p[i:i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def postings(rows: DataFrame, column: str, key: str = "id") -> DataFrame:
    """``(gram, id)`` of all rows; a null value has none."""
    return (rows.where(F.col(column).isNotNull())
            .select(F.explode(grams_of(F.col(column))).alias("gram"), F.col(key).cast("bigint").alias("id")))


def write_postings(rows: DataFrame, column: str, path: str, key: str = "id", mode: str = "overwrite") -> None:
    """Store postings sorted by trigram. A trigram that many rows share is cut
    by id, so no task or file holds all of it."""
    (postings(rows, column, key).repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
     .write.mode(mode).parquet(path))


def add_postings(rows: DataFrame, column: str, path: str, key: str = "id") -> None:
    """Append the postings of new or changed rows."""
    write_postings(rows, column, path, key, "append")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def candidates(index: DataFrame, term: str) -> DataFrame | None:
    """``(id)`` of the rows that have all trigrams of the term; None if it has
    none. Counted per id with map-side combine."""
    grams = term_grams(term)
    if not grams:
        return None
    found = index.where(F.col("gram").isin(grams))
    if len(grams) == 1:
        return found.select("id").distinct()
    # repeated postings (a row added twice) must not count twice
    return (found.groupBy("id").agg(F.collect_set("gram").alias("grams"))     # at most the term's trigrams
            .where(F.size("grams") == len(grams)).select("id"))


def contains(rows: DataFrame, index: DataFrame, column: str, term: str, key: str = "id") -> DataFrame:
    """The rows whose ``column`` contains ``term``, as ``exprs.contains_ci``
    finds them; the few candidates are joined first."""
    ids = candidates(index, term)
    if ids is not None:
        rows = rows.join(ids.withColumnRenamed("id", "_candidate"), F.col(key) == F.col("_candidate"), "left_semi")
    return rows.where(X.contains_ci(column, term))
