"""Line dedup by a segment-partition edit join.

A line is the text between line feeds, compared without surrounding blanks;
blank lines stay. A line goes when

- the same line stands earlier (in order of doc_id, then a hash of the text
  where rows share an id, then line number), however short it is, or
- an earlier line, itself the first of its kind, is at most ``EDITS`` edits
  (insertions, deletions, substitutions of characters) away, both of at least
  ``MIN_CHARS`` characters, of which the edits are at most a quarter. Shorter
  lines are compared exactly only: two edits make another word of them.

The join: every line is cut into EDITS + 1 segments. A line within EDITS edits
of it holds at least one of them whole, shifted by as much as the edits before
and after it allow. So each line is indexed by (length, segment number,
segment) and probes, for its own and each shorter length in reach, just the
substrings at the places a segment can have moved to. The keys of a line are made
and shuffled once (its index keys are among its probes, and marked); a key that no
other line has, or that no line is indexed by, drops out, and with it nearly all
lines.

A key that up to ``CROWD`` rows share gives all their pairs. A crowded key does not:

- every row is paired with the key's earliest line only, its hub. A line near
  its hub goes, and needs no other partner;
- the lines of crowded keys meet again on finer keys, which hold half of a line
  (two of four segments, the other two taking the edits); there too, crowds are
  first settled by their hubs;
- what is left of a crowd then is paired with all earlier lines of its key, as
  the rows settled already need not be.

Character parities (each edit changes at most two) prune pairs inside the joins;
what is left is verified by banded bit-parallel edit distance: one word holds
the band of a column.

Equal lines are found by 64-bit hashes, and the edit join knows a line by its
hash, so repeats need not be taken out of the texts before it; only of lines that
make more than one in ``HOT_SHARE`` of all lines just the first occurrence gets
keys. Texts are rewritten once. They are shuffled, once, only when more than
``BROADCAST_ROWS`` lines go. DataFrame functions only.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, stage, table

EDITS = 2
MIN_CHARS = 4 * EDITS     # of lines in the edit join; every non-blank line counts for exact repeats
PARITY_CHARS = " etaoinsrhdlucmfgpbwvkyz.,"   # one byte each
KEY_BITS = 48
CROWD = 64                # rows of a key up to which all their pairs are made
HOT_SHARE = 100_000       # so there are at most that many hot lines
BROADCAST_ROWS = 1_000_000  # of positions or hashes, joined with whole texts
_LAST = (1 << 63) - 1


def _doc(c: str = "doc_id") -> Column:
    """Order key of a document: null ids come last."""
    return F.coalesce(F.col(c).cast("bigint"), F.lit(_LAST))


def _hint(staged: DataFrame):
    """Broadcast for a staged table of at most BROADCAST_ROWS rows."""
    return F.broadcast if staged.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(row, doc, h, text)``, where (doc, h) is one row's only, and the
    further copies of rows with equal id and text, if any.

    ``row`` holds the other columns. ``h`` is the text's hash where rows share
    the id (also null) and 0 elsewhere, where ``doc`` alone tells rows apart.
    """
    rows = docs.select(F.struct(*[column(n) for n in docs.columns if n != "text"]).alias("row"), _doc().alias("doc"),
                       F.col("text").cast("string").alias("text"))
    shared = stage(rows.where("text is not null").groupBy("doc").count().where("count > 1")
                   .select(F.col("doc").alias("shared")), "shared")
    if not shared.limit(1).count():
        return rows.select("row", "doc", F.lit(0).cast("bigint").alias("h"), "text"), None
    h = F.when(F.col("shared").isNull() | F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("text"))
    rows = (rows.join(_hint(shared)(shared), F.col("doc") == F.col("shared"), "left")
            .select("row", "doc", h.alias("h"), "text"))
    twins = stage(rows.where("h <> 0").groupBy("doc", "h").count().where("count > 1").select("doc", "h"), "twins")
    if not twins.limit(1).count():
        return rows, None
    hint = _hint(twins)
    copies = stage(rows.join(hint(twins), ["doc", "h"]).select("row", "doc", "h", "text")
                   .withColumn("copy", F.monotonically_increasing_id()), "copies")
    first = stage(copies.groupBy("doc", "h").agg(F.min("copy").alias("copy")), "first")
    at = ["doc", "h", "copy"]
    kept = copies.join(first, at, "left_semi").select("row", "doc", "h", "text")
    more = copies.join(first, at, "left_anti").select("row", "doc", "h", "text")
    return rows.join(hint(twins), ["doc", "h"], "left_anti").select("row", "doc", "h", "text").union(kept), more


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _lines(keyed: DataFrame, least: int = 1) -> DataFrame:
    """``(doc, h, no, line)`` of the lines of at least ``least`` characters."""
    parts = keyed.select("doc", "h", F.posexplode(F.split(F.col("text"), "\n")).alias("no", "raw"))
    return (parts.select("doc", "h", "no", _stripped(F.col("raw")).alias("line"))
            .where(F.char_length("line") >= least))


def _without(keyed: DataFrame, removed: DataFrame) -> DataFrame:
    """``keyed`` without the lines ``(doc, h, no)`` of the staged table
    ``removed``; the remaining lines keep their order, ``h`` stays."""
    gone = _hint(removed)(removed.groupBy("doc", "h").agg(F.collect_set("no").alias("gone")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return (keyed.join(gone, ["doc", "h"], "left")
            .select("row", "doc", "h", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text")))


def _blank_lines(copies: DataFrame) -> DataFrame:
    """Copies of another row without their lines, which all stand there."""
    blank = F.array_join(F.filter(F.split("text", "\n"), lambda x: _stripped(x) == ""), "\n")
    return copies.select("row", "doc", "h", blank.alias("text"))


def first_occurrences(keyed: DataFrame) -> DataFrame:
    """Staged ``(of, first, n)`` of the lines that stand more than once: hash,
    first position, number of occurrences (combined map-side)."""
    where = F.struct("doc", "h", "no")
    occurrences = _lines(keyed).select(F.xxhash64("line").alias("of"), "doc", "h", "no")
    return stage(occurrences.groupBy("of").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1"), "first")


def exact_repeats(keyed: DataFrame, first: DataFrame) -> DataFrame:
    """``(doc, h, no)`` of lines that stand earlier too."""
    occurrences = _lines(keyed).select(F.xxhash64("line").alias("of"), "doc", "h", "no")
    return (occurrences.join(_hint(first)(first.select("of", "first")), "of")
            .where(F.struct("doc", "h", "no") != F.col("first")).select("doc", "h", "no"))


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i (from 1) of a line of ``length``
    in ``parts`` segments: all as long, the last ``length % parts`` one longer."""
    base = F.floor(length / F.lit(parts)).cast("int")
    plain = F.lit(parts) - length % F.lit(parts)
    start = F.lit(1) + base * (i - 1) + F.greatest(i - 1 - plain, F.lit(0))
    return start.cast("int"), (base + F.when(i > plain, 1).otherwise(0)).cast("int")


Sizes = list[tuple[Column, Column, Column]]


def _sizes(n: Column, edits: int) -> Sizes:
    """(length, length of a plain segment, number of longer segments) of lines
    of ``n`` characters and of those shorter by up to ``edits``."""
    return [(n - s, F.call_function("div", n - s, F.lit(edits + 1)).cast("int"), (n - s) % F.lit(edits + 1))
            for s in range(edits + 1)]


def _keys(coded: Column, sizes: Sizes, edits: int) -> list[tuple[Column, bool]]:
    """(key, whether it is an index key of the line too) of all substrings where
    a segment of an equal or shorter line may stand, by the bounds on the shift
    from the left and from the right. These keep every substring inside a line
    of at least MIN_CHARS characters. ``coded`` has four bytes a character, so a
    substring is a plain copy."""
    parts, out = edits + 1, []
    for shorter, (length, base, longer) in enumerate(sizes):
        for i in range(1, parts + 1):
            start = base * (i - 1) + F.greatest(longer - (parts - i + 1), F.lit(0))
            size = base + F.when(longer > parts - i, 1).otherwise(0)
            low = max(-(i - 1), shorter - (parts - i))
            high = min(i - 1, shorter + (parts - i))
            for shift in range(low, high + 1):
                piece = F.substring(coded, (start + shift) * 4 + 1, size * 4)
                key = F.xxhash64(length * (parts + 1) + i, piece).bitwiseAND(F.lit((1 << KEY_BITS) - 1))
                out.append((key, shorter == 0 and shift == 0))
    return out


def _coded(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def index_keys(line: Column, n: Column, edits: int = EDITS) -> Column:
    return F.array(*[key for key, own in _keys(_coded(line), _sizes(n, edits), edits) if own])


def probe_keys(line: Column, n: Column, edits: int = EDITS) -> Column:
    return F.array(*[key for key, _ in _keys(_coded(line), _sizes(n, edits), edits)])


def line_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(of, k)``: the hashes of the lines with their probe keys ``k`` (key,
    own); ``own`` marks index keys. What the keys share is computed once a line,
    in columns of its own."""
    n = F.char_length("line")
    names = [f"_{c}{s}" for s in range(edits + 1) for c in ("length", "base", "longer")]
    shared = lines.select(F.xxhash64("line").alias("of"), _coded(F.col("line")).alias("coded"),
                          *[c.alias(name) for c, name in zip([c for size in _sizes(n, edits) for c in size], names, strict=True)])
    sizes = [tuple(F.col(c) for c in names[3 * s:3 * s + 3]) for s in range(edits + 1)]
    keys = F.array(*[F.struct(key.alias("key"), F.lit(own).alias("own")) for key, own in _keys(F.col("coded"), sizes, edits)])
    return shared.select("of", F.explode(keys).alias("k"))


def parity(line: Column) -> Column:
    """Parity of how often each of PARITY_CHARS occurs, one bit each. An edit
    changes at most two of them."""
    bits = F.lit(0).cast("bigint")
    for i, c in enumerate(PARITY_CHARS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        bits = bits + count.bitwiseAND(F.lit(1)).cast("bigint") * (1 << i)
    return bits


def _ways(edits: int, parts: int) -> list[tuple[int, int, list[int], list[int], bool]]:
    """(chosen segments as bits, how much shorter the indexed line is, kept
    segments, their shifts, whether it is an index key) of each finer key."""
    out, seen = [], set()
    for chosen in combinations(range(1, parts + 1), edits):
        kept = [i for i in range(1, parts + 1) if i not in chosen]
        for changes in product(range(-edits, edits + 1), repeat=edits):
            shorter = sum(changes)
            if sum(map(abs, changes)) > edits or not 0 <= shorter <= edits:
                continue
            shifts = [sum(c for w, c in zip(chosen, changes, strict=True) if w < i) for i in kept]
            if (chosen, shorter, tuple(shifts)) in seen:
                continue
            seen.add((chosen, shorter, tuple(shifts)))
            out.append((sum(1 << i for i in chosen), shorter, kept, shifts, shorter == 0 and not any(shifts)))
    return out


def finer_keys(line: Column, n: Column, edits: int = EDITS, parts: int = EDITS + 2) -> Column:
    """An array of (key, own) as in ``line_keys``, on keys of all but ``edits`` of ``parts`` segments.

    Of two lines within ``edits`` edits, ``edits`` segments of the indexed one
    can be chosen that hold all edits; each kept segment is then shifted by the
    net change of the chosen ones before it. A probe tries every way to spread
    at most ``edits`` edits over the chosen segments that gives the difference of
    the lengths. The ways are a constant array under one expression: written
    out one by one they make a method too large to compile."""
    ways = F.array(*[F.struct(F.lit(chosen).alias("chosen"), F.lit(shorter).alias("shorter"),
                              F.array(*map(F.lit, kept)).alias("kept"), F.array(*map(F.lit, shifts)).alias("shifts"),
                              F.lit(own).alias("own")) for chosen, shorter, kept, shifts, own in _ways(edits, parts)])

    def key(way: Column) -> Column:
        length = (n - way["shorter"]).cast("int")
        pieces = []
        for k in range(parts - edits):
            start, size = _segment(length, way["kept"][k], parts)
            pieces.append(F.substring(line, start + way["shifts"][k], size))
        return F.struct(F.xxhash64(length, way["chosen"], *pieces).alias("key"), way["own"].alias("own"))

    return F.transform(ways, key)


def meeting(keyed: DataFrame) -> DataFrame:
    """Staged ``(key, own, of, rows)`` of the distinct rows ``(of, k)`` whose key
    another line has too, one of the lines as an index key. ``rows`` counts the
    key's distinct rows. One shuffle of all keys; a key's rows meet there."""
    tagged = keyed.select("k.key", "k.own", "of")
    every = Window.partitionBy("key")
    counted = tagged.select("key", "own", "of", F.min("of").over(every).alias("least"), F.max("of").over(every).alias("most"),
                            F.max("own").over(every).alias("indexed"))
    met = stage(counted.where((F.col("least") != F.col("most")) & F.col("indexed")).select("key", "own", "of").distinct(), "met")
    return met.join(met.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")


def _pairs(met: DataFrame, texts: DataFrame, edits: int, later=None) -> DataFrame:
    """``(a, b)``: distinct pairs of an indexed and a probing row of one key
    that may be within ``edits``, the earlier line first; with ``later``, only
    those whose later line is in that table ``(at)``."""
    rows = met.join(texts.select("at", "parity"), "at")
    left = rows.where("own").select("key", F.col("at").alias("x"), F.col("parity").alias("px"))
    right = rows.select("key", F.col("at").alias("y"), F.col("parity").alias("py"))
    close = F.bit_count(F.col("px").bitwiseXOR(F.col("py"))) <= 2 * edits
    on = (F.col("l.key") == F.col("r.key")) & (F.col("x") != F.col("y")) & close
    if later is not None:
        marked = later.select("at", F.lit(True).alias("open"))
        left = left.join(marked.withColumnRenamed("at", "x"), "x", "left").withColumnRenamed("open", "ox")
        right = right.join(marked.withColumnRenamed("at", "y"), "y", "left").withColumnRenamed("open", "oy")
        on = on & F.when(F.col("x") < F.col("y"), F.col("oy")).otherwise(F.col("ox"))
    pairs = left.alias("l").join(right.alias("r"), on)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Staged ``(at)``: the later lines of the pairs that are within ``edits``."""
    held = texts.select("at", "line")
    checked = (pairs.join(held.select(F.col("at").alias("a"), F.col("line").alias("x")), "a")
               .join(held.select(F.col("at").alias("b"), F.col("line").alias("y")), "b"))
    enough = F.abs(F.char_length("x") - F.char_length("y")) <= edits
    return stage(checked.where(enough & (edit_distance(F.col("x"), F.col("y"), edits) <= edits))
                 .select(F.col("b").alias("at")).distinct(), "near")


def _hubs(crowds: DataFrame) -> DataFrame:
    """``(a, b)``: every line of a crowded key with the key's earliest line."""
    hub = crowds.groupBy("key").agg(F.min("at").alias("a"))     # combined map-side
    return (crowds.join(hub, "key").where(F.col("at") != F.col("a"))
            .select("a", F.col("at").alias("b")).distinct())


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two lines whose lengths differ by at most ``edits``
    and are above it, exact up to ``edits`` (beyond that, some number above).

    Columns of the matrix run over ``b``. A word of 2 * edits + 2 bits holds
    the vertical differences of the rows around the diagonal; its top bit is
    row ``column + edits``, which is followed down to the last row of ``a`` and
    then along that row.
    """
    width = 2 * edits + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    x, y = F.split(a, ""), F.split(b, "")
    return F.element_at(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))),
                                    lambda s: _banded(s["x"], s["y"], edits, width, mask, top)), 1)


def _banded(x: Column, y: Column, edits: int, width: int, mask: int, top: int) -> Column:
    def matches(c: Column, i: Column) -> Column:
        bits = F.lit(0)
        for t in range(width):
            row = i + (edits - t)
            bits = bits + F.when((row >= 0) & (F.get(x, row) == c), F.lit(top >> t)).otherwise(F.lit(0))
        return F.struct(i.alias("i"), bits.alias("eq"))

    def word(c: Column) -> Column:
        return c.bitwiseAND(F.lit(mask))

    def bit(c: Column, m: Column) -> Column:
        return F.when(c.bitwiseAND(m) != 0, 1).otherwise(0)

    down = F.size(x) - edits      # columns in which the diagonal is followed

    def step(s: Column, col: Column) -> Column:
        vp, vn, eq, i = s["vp"], s["vn"], col["eq"], col["i"]
        d0 = word((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn))

        def rest(d: Column) -> Column:
            hp = vn.bitwiseOR(word(F.bitwise_not(d.bitwiseOR(vp))))
            hn = d.bitwiseAND(vp)

            def finish(h: Column) -> Column:
                p, q = h["hp"], h["hn"]
                half = F.shiftright(d, 1)
                along = F.call_function("shiftright", F.lit(top >> 1), i - down)
                change = F.when(i < down, 1 - bit(d, F.lit(top))).otherwise(bit(p, along) - bit(q, along))
                return F.struct(q.bitwiseOR(word(F.bitwise_not(half.bitwiseOR(p)))).alias("vp"),
                                half.bitwiseAND(p).alias("vn"), (s["dist"] + change).alias("dist"))

            return F.element_at(F.transform(F.array(F.struct(hp.alias("hp"), hn.alias("hn"))), finish), 1)

        return F.element_at(F.transform(F.array(d0), rest), 1)

    start = F.struct(F.lit(mask - (1 << (width - 1 - edits)) + 1).alias("vp"), F.lit(0).alias("vn"),
                     F.lit(edits).alias("dist"))
    return F.aggregate(F.transform(y, matches), start, step, lambda s: s["dist"])


def near_repeats(keyed: DataFrame, edits: int = EDITS, crowd: int = CROWD, first: DataFrame | None = None) -> DataFrame:
    """``(doc, h, no)`` of the first occurrences of lines with an earlier line
    within ``edits``. ``first``: the table of repeated lines, by which hot lines
    are told. Lines have more than ``edits`` characters, so that no segment is
    empty."""
    lines = _lines(keyed, max(1, 4 * edits))
    each = lines
    if first is not None:
        most = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE
        hot = first.where(F.col("n") > max(most, 100)).select("of", "first")
        each = (lines.withColumn("of", F.xxhash64("line")).join(_hint(hot)(hot), "of", "left")
                .where(F.col("first").isNull() | (F.struct("doc", "h", "no") == F.col("first"))))
    met = meeting(line_keys(each, edits))
    wanted = stage(met.select("of").distinct(), "wanted")
    texts = stage(each.select(F.xxhash64("line").alias("of"), F.struct("doc", "h", "no").alias("at"), "line")
                  .join(_hint(wanted)(wanted), "of").groupBy("of").agg(F.min("at").alias("at"), F.first("line").alias("line"))
                  .withColumn("parity", parity(F.col("line"))), "texts")
    places = texts.select("of", "at")
    met = stage(met.join(places, "of").drop("of"), "met")
    found = _near(_pairs(met.where(F.col("rows") <= crowd), texts, edits), texts, edits)
    for finer in (False, True):
        crowds = met.where(F.col("rows") > crowd)
        members = stage(crowds.select("at").distinct(), "members")
        if not members.limit(1).count():
            break
        # lines that are near the hub of any of their keys are settled
        found = stage(found.union(_near(_hubs(crowds), texts, edits)).distinct(), "near")
        rest = stage(members.join(found, "at", "left_anti"), "open")
        if not rest.limit(1).count():
            break
        if finer:
            found = found.union(_near(_pairs(crowds, texts, edits, rest), texts, edits))
        else:
            again = texts.join(members, "at", "left_semi")
            finest = finer_keys(F.col("line"), F.char_length("line"), edits)
            met = stage(meeting(again.select("of", F.explode(finest).alias("k"))).join(places, "of").drop("of"), "met")
            few = _pairs(met.where(F.col("rows") <= crowd), texts, edits, rest)
            found = stage(found.union(_near(few, texts, edits)).distinct(), "near")
    return found.select("at.*").distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines removed from ``text``.

    All rows and all columns stay; a text whose lines all go becomes empty, a
    null text stays null. Rows with one doc_id (also null, which comes last)
    are told apart by their texts and ordered by a hash of them; of rows that
    have the text in common too, one keeps its lines. ``doc_id`` and ``text``
    are needed, other columns are carried along.
    """
    keyed, copies = _keyed(docs)
    first = first_occurrences(keyed)
    gone = exact_repeats(keyed, first).union(near_repeats(keyed, edits, first=first))
    out = _without(keyed, stage(gone, "gone"))
    if copies is not None:
        out = out.union(_blank_lines(copies))
    return out.select(*[F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns])


def with_lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it has that column, set to the text's
    length (null for a null text)."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.char_length(F.col("text").cast("string")).cast(docs.schema["n_chars"].dataType)
    return docs.select(*[n.alias(c) if c == "n_chars" else column(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` after line dedup: line counts and a digest of the text."""
    docs = table(spark, sf_dir, "documents")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    before = docs.withColumn("n_lines", lines)
    kept = dedup_lines(before.select("doc_id", "text", "n_lines"))
    return kept.select("doc_id", "n_lines", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
