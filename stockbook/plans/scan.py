"""Ordered scans that stay balanced when one key holds a large share of rows.

A running total "per product, in time order" is a window partitioned by the
product. If one product holds a third of all rows, that window is one task
holding a third of the data. The helpers here split every key's rows into
chunks of consecutive positions and scan in two levels:

1. per (key, chunk): the chunk's partial aggregate (a hash aggregate with
   map-side combine);
2. per key, over its chunks only: the carry from all earlier chunks (a window
   over the small chunk table);
3. per (key, chunk): the running aggregate inside the chunk plus the carry.

Every window then holds at most ``chunk_rows`` rows of one key, whatever the
key distribution. The chunk is derived from a global order position
(``order_position``), which a distributed sort provides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage

# Rows per chunk never go below this, so small inputs scan in one level.
MIN_CHUNK_ROWS = 1 << 16


def chunk_rows_for(n_rows: int) -> int:
    """Chunk size that balances both scan levels: about sqrt(n) rows."""
    return max(MIN_CHUNK_ROWS, int(math.isqrt(max(n_rows, 1))) + 1)


def order_position(df: DataFrame, order_cols: list, name: str = "seq",
                   materialize: bool = True) -> DataFrame:
    """Attach ``name``: a bigint that increases with ``order_cols`` over the
    whole DataFrame (not dense).

    A range-partitioned sort orders the rows; ``monotonically_increasing_id``
    numbers them inside each sorted partition. The result is checkpointed,
    because a recomputation after a lost executor could sample different
    range bounds and renumber rows.
    """
    out = df.orderBy(*order_cols).withColumn(name, F.monotonically_increasing_id())
    return cut_lineage(out) if materialize else out


_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, carry, inner):
    if op == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    if op == "min":
        return F.least(carry, inner)        # least/greatest skip NULLs
    return F.greatest(carry, inner)


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the most frequent key) in one aggregate job; the whole
    count is both when ``keys`` is empty."""
    if not keys:
        n = df.count()
        return n, n
    r = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
         .agg(F.sum("_n").alias("rows"), F.max("_n").alias("top")).first())
    return int(r["rows"] or 0), int(r["top"] or 0)


def scan_plan(df: DataFrame, keys: list[str], chunk_rows: int | None = None) -> int:
    """Chunk size for ``running_agg`` on ``df`` by ``keys``: 0 (one level,
    a plain window) when no key holds more than a chunk, else the chunk."""
    rows, top = group_sizes(df, keys)
    n = chunk_rows or chunk_rows_for(rows)
    return 0 if top <= n else n


def running_agg(df: DataFrame, keys: list[str], seq: str, specs: dict[str, tuple[str, str]],
                chunk_rows: int, inclusive: bool = True) -> DataFrame:
    """Add running aggregates per ``keys`` in ``seq`` order.

    ``specs`` maps an output column to ``(op, value_column)``, op in
    sum | min | max. With ``inclusive=False`` a row sees only strictly earlier
    rows (by ``seq``; rows of one key must have distinct ``seq``). Sums over
    no rows are 0; min / max over no rows are NULL.

    ``chunk_rows`` > 0 scans in two levels (chunks of that many positions);
    0 uses one plain window per key, for inputs where ``scan_plan`` found no
    key larger than a chunk.
    """
    frame = (Window.unboundedPreceding, 0 if inclusive else -1)
    if not chunk_rows:
        w = (Window.partitionBy(*keys) if keys else Window).orderBy(seq).rowsBetween(*frame)
        d = df
        for o, (op, v) in specs.items():
            d = d.withColumn(o, _combine(op, F.lit(None), _OPS[op](F.col(v)).over(w)))
        return d
    chunk = F.floor(F.col(seq) / F.lit(chunk_rows)).cast("bigint")
    d = df.withColumn("_chunk", chunk)
    part_keys = keys + ["_chunk"]

    # level 1: one partial per (key, chunk)
    parts = d.groupBy(*part_keys).agg(*[_OPS[op](F.col(v)).alias(f"_p_{o}") for o, (op, v) in specs.items()])
    # level 2: carry of all earlier chunks of the key (window over the chunk table)
    # with no key the chunk table is one row per chunk: a global window is small
    wk = (Window.partitionBy(*keys) if keys else Window).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = parts.select(*part_keys, *[_OPS[op](F.col(f"_p_{o}")).over(wk).alias(f"_c_{o}")
                                       for o, (op, _v) in specs.items()])
    # level 3: inside the chunk, plus the carry
    d = d.join(carry, part_keys, "left")
    wc = Window.partitionBy(*part_keys).orderBy(seq).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    for o, (op, v) in specs.items():
        d = d.withColumn(o, _combine(op, F.col(f"_c_{o}"), _OPS[op](F.col(v)).over(wc)))
    return d.drop("_chunk", *[f"_c_{o}" for o in specs])
