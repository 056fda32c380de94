"""Document fingerprints by spot signatures.

Words are runs of letters and digits in lower case. Common words (of the four
corpus languages) are anchors, all others are content words. After each anchor
the next ``CHAIN`` content words form a chain; anchor and chain make one
signature; a content word after six others in a row starts a chain without
anchor. A document's fingerprint is the set of its signatures. A short text
without anchors has chains without anchor instead, and one without content
words its words, so only a text without any word has an empty set.

Fingerprints are compared by the Jaccard likeness of the sets, exactly. Where a
caller asks only for likenesses of at least ``least``, sets are assigned to
partitions of set length: lengths bound the likeness, so sets two or more
partitions apart, or of a length ratio below ``least``, are not intersected
(likeness 0).

The fingerprint is printed as the set length, a colon, and the sorted 32-bit
hashes in hexadecimal. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, stage, table

CHAIN = 2
STRETCH = 6
LEAST = 0.0      # likenesses below this are reported as 0; at 0 every overlap counts
# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or our she so that the "
    "their there they this to was we were which who will with you "
    "am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht "
    "noch nur sich sie sind um und von vor war wie zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et il je la le les leur mais ne nous on ont par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous été "
    "al como con del el ella era esta este fue ha las lo los mi muy más no para pero por se ser sin su sus sí también "
    "una y ya"
).split()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add ``out``: the sorted distinct signature hashes of column ``text``."""
    w, c = f"_{out}_words", f"_{out}_content"
    anchors = sorted(set(ANCHORS))
    df = df.withColumn(w, words_of(F.col(text)))
    # places of the content words
    df = df.withColumn(c, F.filter(
        F.transform(F.col(w), lambda x, i: F.when(x.isin(anchors), F.lit(None)).otherwise(i)), lambda i: i.isNotNull()))

    def words_after(j: Column) -> list[Column]:
        return [F.coalesce(F.get(F.col(w), F.get(F.col(c), j + k)), F.lit("")) for k in range(chain)]

    def run_of(p: Column, j: Column) -> Column:
        """Anchors directly before the content word at place p (number j)."""
        first = F.when(j > 0, F.get(F.col(c), j - 1) + 1).otherwise(F.lit(0))
        return F.slice(F.col(w), first + 1, p - first)

    def spot(p: Column, j: Column) -> Column:
        """Signatures of the anchors before a content word; a content word
        after STRETCH others without any anchor starts a chain of its own."""
        before = F.get(F.col(c), j - STRETCH)
        alone = (j >= STRETCH) & (p - before == STRETCH)
        bare = F.when(alone, F.array(_hash([F.lit(""), *words_after(j)]))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.transform(run_of(p, j), lambda a: _hash([a, *words_after(j)])), bare)

    anchored = F.flatten(F.transform(F.col(c), spot))
    bare = F.transform(F.col(c), lambda p, j: _hash([F.lit(""), *words_after(j)]))
    only = F.transform(F.col(w), lambda x: _hash([x]))
    df = df.withColumn(out, anchored)
    chosen = (F.when(F.size(out) > 0, F.col(out)).when(F.size(c) > 0, bare).otherwise(only))
    return df.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop(w, c)


def fingerprint(signatures: Column) -> Column:
    return F.concat(F.size(signatures).cast("string"), F.lit(":"),
                    F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), ""))


def partition_of(signatures: Column, least: float) -> Column:
    """Number of the set's length partition, for 0 < ``least`` < 1. Partition
    ends grow by 1/least, so two sets of a likeness of at least ``least`` lie in
    one partition or in adjacent ones."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / F.lit(math.log(1 / least)))


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard likeness; two empty sets are alike (1). Below ``least`` it is 0,
    and sets whose lengths already say so are not intersected."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    exact = both / (F.size(a) + F.size(b) - both)
    out = F.when(large == 0, F.lit(1.0))
    if least > 0:
        # the partition number is the cheap test; the ratio decides inside adjacent partitions
        if least < 1:
            out = out.when(F.abs(partition_of(a, least) - partition_of(b, least)) > 1, F.lit(0.0))
        out = out.when(small < large * F.lit(least), F.lit(0.0)).when(exact < least, F.lit(0.0))
    return out.otherwise(exact)


def _order_key(doc_id: Column) -> Column:
    """Descending position: null ids come last."""
    return F.coalesce(F.bitwise_not(doc_id), F.lit((1 << 63) - 1))


def with_next(docs: DataFrame, rows_per_range: int = 500, max_ranges: int = 1 << 20) -> DataFrame:
    """``(doc_id, text, next_text)``: the text of the next row in descending
    doc_id (null ids last, equal ids by a hash of the text, equal texts in scan
    order), after the last row the first.

    A range sort of the keys alone, every ``rows_per_range``-th of which (and the
    first of each sorted partition) begins a range, gives the list of first keys;
    a row finds its range by binary search over that list, and each range is
    ordered in its own window, so texts are shuffled once. The first row of a range is also
    dealt to the range before it, where it only serves as the last row's next
    one. Rows that share an id (also null) have different keys and are cut into
    ranges like any others. The list holds at most ``max_ranges`` keys of 24
    bytes.
    """
    base = id_text(docs).select(_order_key(F.col("doc_id")).alias("pos"), F.xxhash64("text").alias("h"),
                                F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    key = F.struct("pos", "h", "row")
    size = max(rows_per_range, -(-base.count() // max_ranges))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))      # in the sorted partition
    firsts = (base.select("pos", "h", "row").repartitionByRange("pos", "h", "row").sortWithinPartitions("pos", "h", "row")
              .withColumn("place", place).where(F.col("place") % size == 0).select(key.alias("first")))
    cuts = stage(firsts.agg(F.array_sort(F.collect_list("first")).alias("cuts")), "cuts")
    n_cuts = cuts.select(F.size("cuts")).first()[0]
    found = base.select("*", cuts.scalar().alias("cuts")).withColumn("key", key)
    found = found.withColumn("range", _range_of(F.col("key"), F.col("cuts"), n_cuts))
    is_first = F.col("key") == F.get("cuts", F.col("range"))
    before = F.when(F.col("range") == 0, F.size("cuts") - 1).otherwise(F.col("range") - 1)
    to = F.when(is_first, F.array(F.col("range"), before)).otherwise(F.array(F.col("range")))
    dealt = found.select(F.posexplode(to).alias("copy", "range"), "pos", "h", "row", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("copy", "pos", "h", "row")
    return (dealt.withColumn("next_text", F.lead("text").over(order)).where("copy = 0")
            .select("doc_id", "text", "next_text"))


def _range_of(key: Column, cuts: Column, n_cuts: int) -> Column:
    """Index of the last of the sorted ``cuts`` not above ``key``, by binary
    search; the first cut is the least key of all."""
    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"] + 1) / F.lit(2)).cast("int")
        above = F.get(cuts, mid) > key
        return F.struct(F.when(above, state["lo"]).otherwise(mid).alias("lo"),
                        F.when(above, mid - 1).otherwise(state["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), (F.size(cuts) - 1).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(max(1, n_cuts.bit_length())))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def fingerprints(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The query's columns, one row per row of ``docs``.

    A null text is the empty text, whose fingerprint is "0:"; a null doc_id
    stays null and comes last in the order; repeated rows follow one another;
    a single row is its own next document; other columns are ignored.
    """
    n = F.char_length("text")
    third = F.floor(n / F.lit(3)).cast("int")
    rows = (with_next(docs).withColumn("n_chars", n.cast("bigint"))
            .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third),
                                           F.substring(F.col("next_text"), F.lit(1), third))))
    for text, out in (("text", "own"), ("edited", "changed"), ("next_text", "after")):
        rows = with_signatures(rows, text, out)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), least).alias("near_edited"),
        likeness(F.col("own"), F.col("after"), least).alias("near_next"))


def op1_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
