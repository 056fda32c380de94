"""Greedy admission in request order, decided in parallel.

Units (carts, or cart lines) arrive in a total order. A unit is admitted iff
each of its rows fits the capacity of its resource (a product's stock)
left by the *admitted* earlier units: ``need <= cap - taken_before``. A
rejected unit takes nothing, so it can free stock for later units, also on
other resources. Sequentially that is one loop over all units; here it is a
fixed point of set operations:

* per row, two exclusive running sums over the resource in unit order: the
  take of admitted units (lower bound of what is taken) and of admitted +
  undecided units (upper bound);
* a unit whose rows all fit under the upper bound is admitted; a unit with a
  row that fails under the lower bound is rejected; others stay undecided;
* the next round keeps, per resource, only the rows from its first
  undecided unit on, without those of rejected units (they take nothing);
  what admitted units before that point took is final and carried as one
  number per resource (``_base``). Rounds therefore
  shrink to the contended tails instead of rescanning every row;
* each round runs ``PASSES_PER_ROUND`` passes of the bounds before the
  active rows are written again, so checkpoint writes are fewer than passes.

All earlier units of the earliest undecided unit are decided, so its bounds
are equal and it decides; every round therefore decides at least one unit
and the loop ends with the exact sequential answer. In practice it takes a
handful of rounds. There is no round cap. The running sums are the two-level
scans of ``plans.scan`` (a hot product is split into chunks), the per-unit
verdict is a hash aggregate, and each round's states are written to the
shared checkpoint folder so the lineage stays one round deep.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import reuse, written
from ..plans.scan import running_agg, scan_plan

log = logging.getLogger(__name__)

ADMITTED, REJECTED, UNDECIDED = "A", "R", "U"
# Bound passes computed per checkpoint of the active rows.
PASSES_PER_ROUND = 2


def greedy_admission(usage: DataFrame, unit_keys: list[str], res_keys: list[str], seq: str,
                     need: str = "need", take: str = "take", cap: str = "cap",
                     chunk_rows: int | None = None, max_rounds: int | None = None,
                     one_level: bool = False) -> DataFrame:
    """Return ``unit_keys + [admitted, rounds]`` for every unit in ``usage``.

    ``usage`` has one row per (unit, resource): the unit's order ``seq``
    (distinct between units sharing a resource), ``need`` (the amount that
    must fit), ``take`` (the amount consumed when admitted) and ``cap`` (the
    resource's capacity). ``max_rounds`` is for tests only; when it is hit
    the function raises instead of returning an approximate answer.
    ``chunk_rows`` / ``one_level`` pass a scan plan the caller already chose
    (``plans.scan.scan_plan``); by default it is chosen here.
    """
    act = written(usage.select(*unit_keys, *res_keys, seq,
                                   F.col(need).alias("_need"), F.col(take).alias("_take"),
                                   F.col(cap).alias("_cap"),
                                   F.lit(UNDECIDED).alias("_st"), F.lit(0).cast("bigint").alias("_base")), "units")
    if act.isEmpty():
        return act.select(*unit_keys, F.lit(False).alias("admitted"), F.lit(0).alias("rounds")).distinct()
    n = 0 if one_level else (chunk_rows if chunk_rows else scan_plan(act, res_keys))
    decided: list[DataFrame] = []     # (unit_keys, _st) decided per pass
    rounds = 0

    def refine(act: DataFrame) -> DataFrame:
        """One pass of the bounds: a verdict for every undecided unit."""
        # _base covers what admitted units took before the resource's first
        # undecided row, the scan covers the rest
        j = act.select("*",
                       F.when(F.col("_st") == ADMITTED, F.col("_take")).otherwise(F.lit(0)).alias("_a"),
                       F.when(F.col("_st") != REJECTED, F.col("_take")).otherwise(F.lit(0)).alias("_au"))
        j = running_agg(j, res_keys, seq, {"_lo": ("sum", "_a"), "_hi": ("sum", "_au")}, n, inclusive=False)
        room_lo = F.col("_cap") - F.col("_base") - F.col("_lo")
        room_hi = F.col("_cap") - F.col("_base") - F.col("_hi")
        # read by the count, the next pass and the final result; the lineage
        # starts at the round's checkpointed rows
        return reuse(
            j.where(F.col("_st") == UNDECIDED).groupBy(*unit_keys)
            .agg(F.max(F.col("_need") > room_lo).alias("_fail"), F.min(F.col("_need") <= room_hi).alias("_fit"))
            .select(*unit_keys, F.when(F.col("_fail"), F.lit(REJECTED)).when(F.col("_fit"), F.lit(ADMITTED))
                    .otherwise(F.lit(UNDECIDED)).alias("_new")))

    while True:
        # PASSES_PER_ROUND passes share one count and one checkpoint: a later
        # pass reads the earlier passes' verdicts (kept in memory) directly
        for _ in range(max(1, PASSES_PER_ROUND)):
            rounds += 1
            v = refine(act)
            decided.append(v.where(F.col("_new") != UNDECIDED).withColumnRenamed("_new", "_st"))
            act = (act.join(v, unit_keys, "left")
                   .withColumn("_st", F.coalesce(F.col("_new"), F.col("_st"))).drop("_new"))
        left = v.where(F.col("_new") == UNDECIDED).count()
        log.info("admission pass %d: %d undecided", rounds, left)
        if left == 0:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"admission not decided after {rounds} passes ({left} undecided)")
        # next round: per resource only the rows from its first undecided unit on;
        # what admitted units before that point took moves into _base
        front = act.where(F.col("_st") == UNDECIDED).groupBy(*res_keys).agg(F.min(seq).alias("_front"))
        upd = act.join(front, res_keys, "inner")
        moved = (upd.where((F.col(seq) < F.col("_front")) & (F.col("_st") == ADMITTED))
                 .groupBy(*res_keys).agg(F.sum("_take").alias("_moved")))
        act = written(
            upd.where((F.col(seq) >= F.col("_front")) & (F.col("_st") != REJECTED)).join(moved, res_keys, "left")
            .withColumn("_base", F.col("_base") + F.coalesce(F.col("_moved"), F.lit(0)).cast("bigint"))
            .drop("_front", "_moved"), "units")
        if len(decided) >= 16:
            # keep the union of per-pass results shallow
            decided = [written(reduce(DataFrame.unionByName, decided), "decided")]
    states = reduce(DataFrame.unionByName, decided)
    return states.select(*unit_keys, (F.col("_st") == ADMITTED).alias("admitted"),
                         F.lit(rounds).alias("rounds"))


def taken_before(usage: DataFrame, admitted: DataFrame, unit_keys: list[str], res_keys: list[str],
                 seq: str, take: str = "take", chunk_rows: int | None = None) -> DataFrame:
    """For every row of ``usage``: ``taken`` = the take of admitted units
    strictly earlier on its resource, and ``touched`` = whether any was
    admitted (exact, after ``greedy_admission``)."""
    n = chunk_rows if chunk_rows is not None else scan_plan(usage, res_keys)
    j = usage.join(admitted.select(*unit_keys, "admitted"), unit_keys, "left")
    j = j.withColumn("_a", F.when(F.coalesce(F.col("admitted"), F.lit(False)), F.col(take)).otherwise(F.lit(0)))
    j = j.withColumn("_ac", F.when(F.coalesce(F.col("admitted"), F.lit(False)), F.lit(1)).otherwise(F.lit(0)))
    j = running_agg(j, res_keys, seq, {"taken": ("sum", "_a"), "_n": ("sum", "_ac")}, n, inclusive=False)
    return j.withColumn("touched", F.col("_n") > 0).drop("_a", "_ac", "_n")
