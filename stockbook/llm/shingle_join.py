"""Exact n-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles (64-bit hashes). Two sets
of sizes ``a <= b`` with Jaccard at least g have ``b <= a / g`` and differ in at
most ``(a + b)(1 - g) / (1 + g)`` elements. So sizes are cut into bands whose
ends grow by ``1 / g``: linked sets lie in one band or in two adjacent ones,
and in the space of a band and the next, at most ``k`` elements differ.

In each space the feature domain is hashed into partitions, two of them to
every first-level group, and the subsets of one partition are enumerated
(PartEnum with n2 = 2, k2 = 1, the choice with the fewest signatures): a
signature is a partition with the elements that the set has in it. At most k
partitions can differ, so linked sets agree on all others. There are enough
partitions that a set usually has elements in more than k of them; then an
agreeing one has elements, and the signatures of empty partitions, which very
many sets would share, are left out. The few sets spread thinner than that
also emit their empty partitions, so no link between two of them is lost.

1. equal sets are one node (copies are never compared). A node has a bit-parity
   sketch: two sketches differ in no more places than the sets in elements;
2. signatures are sorted together. Groups of less than ``HOT`` nodes give all
   their pairs;
3. linked sets agree in at least ``slack`` signatures, the number of used
   partitions above k. A node with fewer hot signatures than slack therefore
   meets every partner in a small group too, and leaves its hot groups. In a
   hot group only the other nodes stay, and each is paired with the first one;
4. pairs whose sketches differ too much are dropped, the rest are verified on
   the sets, and the verified links give components;
5. nodes that hot groups join, where they still are in several components, are
   compared in full, by sketches and sets, and at most one link per joined pair
   of components is emitted. More than ``BLOCK`` such nodes are dealt to tasks
   in pairs of blocks.

Every link between different components is found, so the components are those
of all links. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, id_text, stage, table
from .components import connected_components

WIDTH = 5
SHARE = 75          # link when 100 * intersection >= SHARE * union
HOT = 8             # nodes from which on a signature's group is hot
BLOCK = 2048        # nodes compared in one task at a time
SPACE_BITS = 6      # low bits of a signature: its space
SIGNATURE_BITS = 48
BROADCAST_NODES = 200_000
_OUT_ROWS = 200_000


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finalizer (fixed constants of splitmix64) of an array."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles: A-Z in lower case,
    words cut at ASCII white space; with fewer words than ``width`` the whole
    sequence is one shingle; without words the set is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    w = min(n, width)
    s = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        s *= np.uint64(0xD6E8FEB86659FD93)
        s += h[k:n - w + 1 + k]
    s = _mix(s)
    s.sort()
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def node_of(hashes: np.ndarray) -> int:
    """The set's identity as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


@lru_cache(None)
def band_ends(limit: int, share: int) -> tuple[int, ...]:
    """Largest sizes of the bands up to ``limit``."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // share))
    return tuple(ends)


@lru_cache(65_536)
def spaces(size: int, share: int = SHARE) -> list[tuple[int, int, int]]:
    """(space, k, partitions) of the spaces that a set of this size is in."""
    ends = band_ends(1 << max(4, (size - 1).bit_length()), share)
    band = int(np.searchsorted(ends, size))
    out = []
    for i in (band, band - 1):
        if i >= 0:
            r = ends[i]
            k = (r + r * 100 // share) * (100 - share) // (100 + share)
            out.append((i, k, max(k + 1, math.ceil(0.42 * r + 1.2 * math.sqrt(r) + 4))))
    return out


@lru_cache(256)
def _partition_salts(space: int, partitions: int) -> np.ndarray:
    """What tells the signatures of a space's partitions apart."""
    return _mix(np.uint64(space << 32) + np.arange(partitions, dtype=np.uint64), 3)


def signatures(hashes: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The set's PartEnum signatures over all its spaces, and (space, slack)
    of each space."""
    place, element = _mix(hashes, 1) >> np.uint64(32), _mix(hashes, 2)
    out, slacks = [], []
    for space, k, partitions in spaces(len(hashes), share):
        p = ((place * np.uint64(partitions)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(partitions, np.uint64)
        np.add.at(sums, p, element)
        used = np.flatnonzero(np.bincount(p, minlength=partitions))
        which = used if len(used) > k else np.arange(partitions)
        mixed = _mix(sums[which] ^ _partition_salts(space, partitions)[which])
        out.append((mixed >> np.uint64(64 - SIGNATURE_BITS + SPACE_BITS) << np.uint64(SPACE_BITS)) | np.uint64(space))
        slacks.append((space, len(used) - k))
    return np.concatenate(out).astype(np.int64), slacks


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the elements hashed to 64 * 2**i places, about one or two
    for each element."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    at = (_mix(hashes, 4) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded to ``size`` words: neighbouring places share a parity."""
    while len(x) > size:
        b = np.unpackbits(x.view(np.uint8))
        x = np.packbits(b[0::2] ^ b[1::2]).view(np.uint64)
    return x


def may_link(a: bytes, b: bytes, n: int, m: int, share: int = SHARE) -> bool:
    """Whether sets of sizes n, m with these sketches can link."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return min(n, m) * 100 >= share * max(n, m) and differ <= (n + m) * (100 - share) // (100 + share)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    """Whether two sorted distinct arrays link."""
    if min(len(a), len(b)) * 100 < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def _sets(docs: DataFrame, width: int, share: int) -> DataFrame:
    """``(doc_id, h, n_shingles, node, sketch, slacks)`` of every row, ``h`` the
    text's hash; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sketches, slacks = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
                slacks.append([{"space": a, "slack": b} for a, b in _slacks(s, share)] if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()),
                                   pa.array(node, pa.int64()), pa.array(sketches, pa.binary()),
                                   pa.array(slacks, _SLACKS)],
                                  names=["doc_id", "h", "n_shingles", "node", "sketch", "slacks"])

    return (id_text(docs).withColumn("h", F.xxhash64("text"))
            .mapInArrow(run, "doc_id bigint, h bigint, n_shingles bigint, node bigint, sketch binary, "
                             "slacks array<struct<space:int,slack:int>>"))


_SLACKS = pa.list_(pa.struct([("space", pa.int32()), ("slack", pa.int32())]))


def _slacks(hashes: np.ndarray, share: int) -> list[tuple[int, int]]:
    place = _mix(hashes, 1) >> np.uint64(32)
    return [(space, np.count_nonzero(np.bincount(((place * np.uint64(parts)) >> np.uint64(32)).astype(np.int64))) - k)
            for space, k, parts in spaces(len(hashes), share)]


def _signature_rows(docs: DataFrame, width: int, share: int) -> DataFrame:
    """``(sig, node)``; a node met again by the same task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, nodes, n = [], [], 0
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                sigs.append(signatures(s, share)[0])
                nodes.append(np.full(len(sigs[-1]), node, np.int64))
                n += len(nodes[-1])
                if n > _OUT_ROWS:
                    yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))],
                                          names=["sig", "node"])
                    sigs, nodes, n = [], [], 0
            if n:
                yield pa.record_batch([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))],
                                      names=["sig", "node"])

    return id_text(docs).select("text").mapInArrow(run, "sig bigint, node bigint")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, node) to (a, b, sig): all pairs (a, b, null) of a
    small group, the members (node, null, sig) of a hot one. A group is held
    until it ends or is known to be hot."""

    def members(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(sig)], names=["a", "b", "sig"])

    held_sig, held_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot, last = None, None       # the hot group under way and its last node
    for batch in batches:
        sig = np.concatenate([held_sig, batch.column("sig").to_numpy(zero_copy_only=False)])
        node = np.concatenate([held_node, batch.column("node").to_numpy(zero_copy_only=False)])
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        fresh[0] = not (hot is not None and sig[0] == hot and node[0] == last)
        sig, node = sig[fresh], node[fresh]
        more = int(np.searchsorted(sig, hot, "right")) if hot is not None and len(sig) and sig[0] == hot else 0
        if more:
            yield members(sig[:more], node[:more])
            last = node[more - 1]
            sig, node = sig[more:], node[more:]
        if not len(sig):
            held_sig, held_node = sig, node
            continue
        hot = None
        end = int(np.searchsorted(sig, sig[-1], "left"))
        held_sig, held_node = sig[end:], node[end:]
        if len(held_sig) >= HOT:
            yield members(held_sig, held_node)
            hot, last = held_sig[0], held_node[-1]
            held_sig, held_node = held_sig[:0], held_node[:0]
        yield from _small_groups(sig[:end], node[:end], members)
    yield from _small_groups(held_sig, held_node, members)


def _small_groups(sig: np.ndarray, node: np.ndarray, members) -> Iterator[pa.RecordBatch]:
    """Whole groups: pairs of the small ones, members of the others."""
    if not len(sig):
        return
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig))).repeat(np.diff(np.append(first, len(sig))))
    big = size >= HOT
    if big.any():
        yield members(sig[big], node[big])
    sig, node = sig[~big], node[~big]
    pairs = [np.stack([node[:-d], node[d:]], 1)[sig[:-d] == sig[d:]] for d in range(1, min(HOT - 1, len(sig) - 1) + 1)]
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    if len(pairs):
        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()),
                               pa.nulls(len(pairs), pa.int64())], names=["a", "b", "sig"])


def _stay_hot(hot: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows ``(sig, node)`` of hot groups whose node has at least as many
    hot signatures in their space as its slack there."""
    space = F.col("sig").bitwiseAND(F.lit((1 << SPACE_BITS) - 1)).cast("int")
    hot = hot.withColumn("space", space)
    slack = nodes.select("node", F.explode("slacks").alias("s")).select("node", "s.space", "s.slack")
    stays = (hot.groupBy("node", "space").agg(F.count(F.lit(1)).alias("n")).join(slack, ["node", "space"])
             .where("n >= slack").select("node", "space"))
    return hot.join(stays, ["node", "space"]).select("sig", "node")


def _sift(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs that may link by size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("x", "y", "n", "m")]
            ok = pa.array([may_link(x, y, n, m, share) for x, y, n, m in zip(*cols, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m"))
    close = F.least("n", "m") * 100 >= F.greatest("n", "m") * share
    return (pairs.join(one, "a").join(two, "b").where(close).select("a", "b", "x", "y", "n", "m")
            .mapInArrow(run, "a bigint, b bigint"))


def _node_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)``, one row each, of the distinct nodes of the staged
    table ``wanted (node, h)``, ``h`` the hash of a text of the node. Only texts
    of these hashes are cut into shingles again; up to BROADCAST_NODES hashes
    are broadcast, more make a shuffled join."""
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    texts = wanted.select("h").distinct()
    rows = id_text(docs).join(F.broadcast(texts) if few else texts, F.xxhash64("text") == F.col("h"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, blobs, n = [], [], 0
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                out.append(node)
                blobs.append(s.tobytes())
                n += len(s)
                if n > _OUT_ROWS:
                    yield pa.record_batch([pa.array(out, pa.int64()), pa.array(blobs, pa.binary())],
                                          names=["node", "hashes"])
                    out, blobs, n = [], [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.int64()), pa.array(blobs, pa.binary())],
                                      names=["node", "hashes"])

    return rows.select("text").mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v, np.uint64) for v in batch.column("x").to_pylist()]
            y = [np.frombuffer(v, np.uint64) for v in batch.column("y").to_pylist()]
            ok = pa.array([linked(p, q, share) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(ok)

    joined = (pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
              .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a"))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row per set: the parity of its elements hashed to ``bits`` places.
    Two rows differ in no more places than the sets in elements."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        odd = np.bincount((_mix(s, 4) >> np.uint64(64 - int(math.log2(bits)))).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8))
    return out.view(np.uint64)


def _compare_group(share: int):
    """All pairs of different components inside one group (or two blocks of
    one); emits a link only where it joins what no earlier link joined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        node, comp = pdf["node"].to_numpy(), pdf["component"].tolist()
        sets = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
        n = np.array([len(s) for s in sets])
        bits = 1 << max(9, int(2 * n.max() - 1).bit_length())
        rows = _parity(sets, bits)
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i in range(len(node) - 1):
            differ = np.bitwise_count(rows[i + 1:] ^ rows[i]).sum(1)
            most = (n[i + 1:] + n[i]) * (100 - share) // (100 + share)
            for j in np.flatnonzero(differ <= most) + i + 1:
                a, b = find(comp[i]), find(comp[j])
                if a != b and linked(sets[i], sets[j], share):
                    root[max(a, b)] = min(a, b)
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _remaining_groups(starred: DataFrame, components: DataFrame) -> DataFrame:
    """``(group, node, component)``: nodes joined by hot groups, however many
    groups join them, where they are in several components; large ones in pairs
    of blocks. Any two nodes of one hot group are in one group here."""
    joined = connected_components(starred).withColumnRenamed("component", "cluster")
    members = stage(joined.join(components, "node", "left")
                    .select("cluster", "node", F.coalesce("component", "node").alias("component")), "members")
    split = (members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"),
                                            F.max("component").alias("hi")).where("lo <> hi"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
    return (members.join(split.select("cluster", blocks.alias("blocks")), "cluster").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.struct("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
                    .alias("group"), "node", "component"))


def _joined(docs: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The staged sets of all rows, and ``(node, component)`` of the nodes that
    have a link."""
    sets = stage(_sets(docs, width, share), "sets")
    nodes = stage(sets.where("node is not null").select("node", "n_shingles", "sketch", "slacks", "h")
                  .dropDuplicates(["node"]), "nodes")
    rows = _signature_rows(docs, width, share).repartition("sig").sortWithinPartitions("sig", "node")
    met = stage(rows.mapInArrow(_meet, "a bigint, b bigint, sig bigint"), "met")
    hot = stage(_stay_hot(met.where("sig is not null").select("sig", F.col("a").alias("node")), nodes), "hot")
    hubs = hot.groupBy("sig").agg(F.min("node").alias("a"))
    starred = stage(hot.join(hubs, "sig").select("a", F.col("node").alias("b")).where("a <> b").distinct(), "starred")
    pairs = met.where("sig is null").select("a", "b").union(starred).distinct()
    pairs = stage(_sift(pairs, nodes, share), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    wanted = stage(nodes.select("node", "h").join(wanted, "node"), "wanted")
    hashes = stage(_node_sets(docs, wanted, width), "hashes")
    found = stage(_verify(pairs, hashes, share), "found")
    components = connected_components(found)
    groups = stage(_remaining_groups(starred, components), "groups")
    if groups.limit(1).count():
        more = (groups.join(hashes, "node").groupBy("group")
                .applyInPandas(_compare_group(share), "a bigint, b bigint"))
        components = connected_components(found.union(more))
    return sets, components


def ngram_jaccard_join(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the
    document included. A null or empty text has an empty set, linked with
    nothing; rows with equal sets link, also repeated rows; a null ``doc_id``
    takes part in links but is never the smallest (a component of null ids has
    a null ``component_id``); other columns are ignored.
    """
    sets, components = _joined(docs, width, share)
    own = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    own = own.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = own.select("node", "component").join(least, "component").select("node", "component_id")
    return (sets.join(by_node, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``docs``, all columns, with one row of each component: the one of least
    doc_id (null last), then least text hash. Rows stay or go by their own text,
    whatever other rows have their id; those without words all stay."""
    names = docs.columns
    sets, components = _joined(docs, width, share)
    key = F.struct("doc_id", "h")
    rows = (sets.where("node is not null").groupBy("doc_id", "h", "node").agg(F.count(F.lit(1)).alias("n"))
            .join(components, "node", "left").select("doc_id", "h", "n", F.coalesce("component", "node").alias("component")))
    rows = stage(rows, "rows")
    least = (rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"))
             .select("component", F.struct("least.doc_id", "least.h").alias("least")))
    judged = rows.join(least, "component")
    gone = stage(judged.where(key != F.col("least")).select(key.alias("gone_id")), "gone")
    twice = stage(judged.where((key == F.col("least")) & (F.col("n") > 1)).select(key.alias("twice")), "twice")

    def hint(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else ids

    held = docs.select(F.struct(*[column(n) for n in names]).alias("row"),
                       F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                                F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")).alias("id"))
    left = held.join(hint(gone), F.col("id") == F.col("gone_id"), "left_anti")
    if twice.limit(1).count():
        again = F.col("id") == F.col("twice")
        once = left.join(hint(twice), again, "left_semi").groupBy("id").agg(F.first("row").alias("row"))
        left = left.join(hint(twice), again, "left_anti").select("row").union(once.select("row"))
    return left.select(*[F.col("row").getField(n).alias(n) for n in names])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents`` (5-word shingles, 0.75)."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
