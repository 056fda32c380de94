"""Mixing sources to target token weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` times all words; a target stops at ``most`` times its source's
words and the excess is shared anew by weight. That is the level ``v`` with
``target = min(most * words, v * weight)``, found on the table of sources.

Rates: document i is taken ``r_i`` times, 0 < r_i < ``most``. The rates of
least (bounded) relative entropy to 1 that meet the token constraint of each
source are exponentially tilted by size, ``r_i = most / (1 + exp(-t_s x_i))``
with ``x_i`` the size over the source's mean. The tilts ``t_s`` solve the
convex dual by Newton steps (kept inside a shrinking bracket); a step is one
aggregation per source over the histogram of sizes.

Copies: whole numbers. Each row has a repeatable number u; it gets one copy
above the whole part of its rate when u minus the fraction lies below its
source's threshold. Thresholds come from histograms of that difference,
refined three times, so that the words taken pass the target by less than a
row; then a few rows whose size is closest to what is still off are taken once
more or once less.

DataFrame operations only. Everything per source is a map-side combined
aggregate; a source with a third of all rows is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, n_words, stage, table, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BINS = 256
NEWTON_STEPS = 8     # per round, each written
ROUNDS = 8
REPAIRS = 3


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, rows)``: equal rows are one unit."""
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        n_words(F.col("text").cast("string")).alias("size"))
            .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """``sources (source, words, rows)`` with ``s`` (1..n in order) and ``target``."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("s") - 1) % len(weights) + 1)
    ranked = (sources.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
              .withColumn("weight", w).withColumn("stop", F.col("words") * F.lit(float(most))))
    # sources that stop earliest first: the level after the first j have stopped
    order = Window.orderBy(F.col("stop") / F.col("weight"), "s")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("level", (F.sum("words").over(everything) * F.lit(share)
                                         - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
                               / F.sum("weight").over(after))
    holds = F.col("level") * F.col("weight") <= F.col("stop")
    ranked = ranked.withColumn("v", F.first(F.when(holds, F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("source", "words", "rows", "s",
                         F.least("stop", F.coalesce(F.col("v") * F.col("weight"), F.col("stop"))).alias("target"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    return F.lit(float(most)) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * x))))


def tilts(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``(s, mean, tilt)`` solving the dual; ``sizes (s, size, n)`` is the
    histogram of sizes, ``sources`` a staged table."""
    state = sources.select("s", "target", (F.col("words") / F.col("rows")).alias("mean"), F.lit(0.0).alias("tilt"),
                           F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("off"))
    x = F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9))
    words = F.col("size") * F.col("n")
    few = _few(sources)
    kept = ["s", "target", "mean", "tilt", "lo", "hi"]
    for _ in range(ROUNDS):
        for _ in range(NEWTON_STEPS):
            rate = _rate(F.col("tilt"), x, most)
            bound = F.lit(1.0) + F.abs("tilt") * 2
            newton = F.col("gap") / F.greatest(F.col("slope"), F.lit(1e-12))
            state = (sizes.join(few(state.select(*kept)), "s").groupBy(*kept)
                     .agg((F.col("target") - F.sum(words * rate)).alias("gap"),
                          F.sum(words * x * rate * (F.lit(1.0) - rate / most)).alias("slope"))
                     .withColumn("lo", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("lo")))
                     .withColumn("hi", F.when(F.col("gap") <= 0, F.col("tilt")).otherwise(F.col("hi")))
                     .withColumn("to", F.col("tilt") + F.greatest(-bound, F.least(bound, newton)))
                     .select("s", "target", "mean",
                             F.when(F.col("gap") == 0, F.col("tilt"))
                             .when((F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi")), F.col("to"))
                             .otherwise((F.col("lo") + F.col("hi")) / 2).alias("tilt"),
                             "lo", "hi", (F.abs("gap") / F.greatest(F.col("target"), F.lit(1.0))).alias("off")))
            # every step is a small plan of the same shape: the driver plans and compiles it once
            state = stage(state, "tilts")
        if (state.agg(F.max("off")).first()[0] or 0.0) < 1e-7:
            break
    return state.select("s", "mean", "tilt")


def _few(sources: DataFrame, rows: int = 20_000):
    """The hint for tables of one row per source: broadcast up to ``rows``
    sources, a shuffled join beyond."""
    return F.broadcast if sources.limit(rows + 1).count() <= rows else (lambda df: df)


def _thresholds(rows: DataFrame, sources: DataFrame, few, levels: int = 3) -> DataFrame:
    """``(s, prefix)``: rows of a source whose ``at`` (in [0, 1)) lies below
    ``prefix / BINS**levels`` get the further copy."""
    base = rows.groupBy("s").agg(F.sum(F.col("base") * F.col("words")).alias("has"))
    state = (sources.select("s", "target").join(few(base), "s")
             .select("s", F.lit(0).cast("bigint").alias("prefix"), (F.col("target") - F.col("has")).alias("need")))
    for level in range(1, levels + 1):
        scale = BINS ** (level - 1)
        inside = (rows.where(F.col("open")).join(few(state), "s")
                  .where(F.floor(F.col("at") * scale) == F.col("prefix"))
                  .withColumn("bin", F.floor(F.col("at") * (scale * BINS)) - F.col("prefix") * BINS)
                  .groupBy("s", "bin", "need").agg(F.sum("words").alias("words")))
        upto = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        crossed = (inside.withColumn("sum", F.sum("words").over(upto))
                   .where(F.col("sum") > F.col("need")).groupBy("s")
                   .agg(F.min(F.struct("bin", (F.col("sum") - F.col("words")).alias("before"))).alias("c")))
        state = stage(state.join(few(crossed), "s", "left").select(
            "s", F.coalesce(F.col("prefix") * BINS + F.col("c.bin"), (F.col("prefix") + 1) * BINS).alias("prefix"),
            (F.col("need") - F.coalesce(F.col("c.before"), F.lit(0))).alias("need")), "thresholds")
    return state.select("s", "prefix")


def _repairs(rows: DataFrame, sources: DataFrame, few, most: int, times: int = REPAIRS) -> DataFrame:
    """``(s, done)``: the units of each source, one a time, whose words are
    closest to what is still off and that are taken once more or once less,
    where that comes closer."""
    taken = rows.groupBy("s").agg(F.sum(F.col("copies") * F.col("words")).alias("taken"))
    state = sources.select("s", "target").join(few(taken), "s").select(
        "s", (F.col("target") - F.col("taken")).alias("off"),
        F.array().cast("array<struct<doc_id:bigint,size:bigint,sign:int>>").alias("done"))
    for _ in range(times):
        state = stage(state, "repairs")
        room = F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        seen = F.exists("done", lambda d: d["doc_id"].eqNullSafe(F.col("doc_id")) & (d["size"] == F.col("size")))
        best = (rows.join(few(state), "s")
                .where((F.col("words") > 0) & room & ~seen & (F.col("words") < F.abs("off") * 2))
                .groupBy("s").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("words")).alias("d"), "u", "doc_id",
                                                 "size", "words", F.signum("off").cast("int").alias("sign"))).alias("b")))
        change = F.coalesce(F.col("b.words") * F.col("b.sign"), F.lit(0))
        more = F.when(F.col("b").isNotNull(), F.array(F.struct("b.doc_id", "b.size", "b.sign"))).otherwise(F.array())
        state = state.join(few(best), "s", "left").select(
            "s", (F.col("off") - change).alias("off"),
            F.concat("done", more.cast("array<struct<doc_id:bigint,size:bigint,sign:int>>")).alias("done"))
    return state.select("s", "done")


def balance(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """``(doc_id, source, size, rows, source_size, target, copies)`` per unit.

    A unit is a distinct (doc_id, source, size) and ``rows`` its number of
    rows, which are all taken ``copies`` times (0..most). A null text has size
    0, a null source is a source of its own (the last one), a null ``doc_id``
    is an id like any other; an empty table gives no rows.
    """
    all_units = stage(units(docs), "units")
    sources = all_units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"),
                                              F.sum("rows").alias("rows"))
    sources = stage(targets(sources, weights, share, most), "sources")
    few = _few(sources)
    key = sources.select(F.col("source").alias("key"), "s")
    rows = all_units.join(few(key), F.col("source").eqNullSafe(F.col("key"))).select("s", "doc_id", "size", "rows")
    rows = stage(rows, "rows")
    sizes = stage(rows.groupBy("s", "size").agg(F.sum("rows").alias("n")), "sizes")
    tilt = tilts(sizes, sources, most)
    rate = _rate(F.col("tilt"), F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9)), most)
    rated = (rows.join(few(tilt), "s").withColumn("rate", rate)
             .withColumn("words", F.col("size") * F.col("rows"))
             .withColumn("u", unit_hash(F.col("doc_id"), F.col("size"), F.col("s")))
             .withColumn("base", F.least(F.floor("rate"), F.lit(most)).cast("int"))
             .withColumn("open", F.col("base") < most)
             .withColumn("at", (F.col("u") - (F.col("rate") - F.col("base")) + 1) / 2)
             .select("s", "doc_id", "size", "rows", "words", "u", "base", "open", "at"))
    rated = stage(rated, "rated")
    prefix = _thresholds(rated, sources, few)
    more = F.col("open") & (F.floor(F.col("at") * BINS**3) < F.col("prefix"))
    decided = (rated.join(few(prefix), "s")
               .withColumn("copies", F.col("base") + more.cast("int"))
               .select("s", "doc_id", "size", "rows", "words", "u", "copies"))
    decided = stage(decided, "decided")
    mine = F.filter("done", lambda d: d["doc_id"].eqNullSafe(F.col("doc_id")) & (d["size"] == F.col("size")))
    decided = (decided.join(few(_repairs(decided, sources, few, most)), "s")
               .withColumn("copies", F.col("copies") + F.coalesce(F.get(mine, F.lit(0))["sign"], F.lit(0))))
    named = sources.select("s", "source", F.col("words").alias("source_size"), "target")
    return stage(decided.join(few(named), "s").select("doc_id", "source", "size", "rows", "source_size", "target",
                                                      "copies"), "mix")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as it is taken."""
    names = docs.columns
    mixed = balance(docs, **options).select(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"),
                                                     F.col("size").alias("n")).alias("unit"), "copies")
    held = docs.select(F.struct(*[column(n) for n in names]).alias("row"),
                       F.struct(F.col("doc_id").cast("bigint").alias("i"), F.col("source").cast("string").alias("s"),
                                n_words(F.col("text").cast("string")).alias("n")).alias("of"))
    joined = held.join(mixed.where("copies > 0"), F.col("of").eqNullSafe(F.col("unit")))
    return (joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k"))
            .select(*[F.col("row").getField(n).alias(n) for n in names]))


def op3_columns(mixed: DataFrame) -> DataFrame:
    """One row per row of the documents, with the words taken of it."""
    return (mixed.select("doc_id", "source", "size", "source_size", "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"),
                         F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("k")).drop("k"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix with the standard weights takes of ``documents``."""
    return op3_columns(balance(table(spark, sf_dir, "documents")))
