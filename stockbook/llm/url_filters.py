"""URL filters by a Bloom filter cascade.

A rule is a host and a path start; it fits the host itself and its subdomains.
A URL therefore holds a rule if one of its keys is listed: a key is a suffix of
the host (cut at dots) followed by a start of the path. Only keys of a listed
shape (number of host labels, length of the path start) are formed, longest
first, so the first listed key is the longest rule that fits.

Which keys are listed is read from a cascade of Bloom filters:

- level 1 encodes the listed keys. The keys of the corpus that pass it though
  they are not listed are its false positives, found by one scan of all URLs;
- level 2 encodes these, and the listed keys that pass level 2 are its false
  positives; level 3 encodes those, and so on in turn, until a level lets
  nothing wrong through.

A key is listed if it passes level 1 and not (passes level 2 and not (...)).
Over the keys that the cascade was built for (all listed keys and all keys of
the corpus) that is exact, so the URLs need no join. Level 1 has the rate
sqrt(1/2) * listed / corpus keys, the others 1/2: the levels then need a few bits
a listed key and grow with the logarithm of the corpus only.

A second cascade tells, among listed keys, the blocked from the allowed.

A filter is one array of 64-bit words, read as a scalar subquery. A level of
more than ``MAX_BITS`` bits is never made: keys are dealt by hash to as many
groups as that takes, each with a cascade of its own, and the URLs pass through
the groups one after the other. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stage, table

MAX_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
# The rules of the query (verdict, host, path).
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


def host_of(url: Column) -> Column:
    """Host with A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path, from the end of the host; empty for null or without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` is a staged table of one row, an array."""

    words: DataFrame
    bits: int
    probes: int
    seed: int

    def holds(self, key: Column, words: Column) -> Column:
        """Whether the key's bits are all set."""
        return F.forall(F.sequence(F.lit(0), F.lit(self.probes - 1)), lambda j: F.getbit(
            F.get(words, (self.position(key, j) / F.lit(64)).cast("int")),
            F.pmod(self.position(key, j), F.lit(64)).cast("int")) == 1)

    def position(self, key: Column, j: Column) -> Column:
        return _position(key, j, self.bits, self.seed)


def _position(key: Column, j: Column, bits: int, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), key)
    low, high = h.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(h, 33)
    return F.pmod(low + (high * F.lit(2) + F.lit(1)) * j, F.lit(bits).cast("bigint"))


def level_size(n: int, rate: float) -> tuple[int, int]:
    """(bits, probes) of a filter of ``n`` keys with this false positive rate."""
    probes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2)), probes


def encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of ``n`` keys ``(key)``. Bits are combined map-side by word."""
    bits, probes = level_size(n, rate)
    at = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)),
                                           lambda j: _position(F.col("key"), j, bits, seed))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    words = (at.select((F.col("at") / 64).cast("bigint").alias("word"), one.alias("set"))
             .union(keys.sparkSession.range(-(-bits // 64)).select("id", F.lit(0).cast("bigint")))
             .groupBy("word").agg(F.bit_or("set").alias("set")))
    ordered = F.array_sort(F.collect_list(F.struct("word", "set")))     # at most MAX_BITS / 64 words
    return Level(stage(words.agg(F.transform(ordered, lambda x: x["set"]).alias("words")), "filter"), bits, probes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the filters as columns ``name`` and a number."""
        return df.select("*", *[v.words.scalar().alias(f"{name}{i}") for i, v in enumerate(self.levels)])

    def lists(self, key: Column, name: str) -> Column:
        """Whether ``key`` is listed; the filters are attached as ``name``."""
        out = F.lit(False)
        for i in reversed(range(len(self.levels))):
            out = self.levels[i].holds(key, F.col(f"{name}{i}")) & ~out
        return out


def first_rate(listed: int, others: int) -> float:
    return min(0.5, math.sqrt(0.5) * listed / max(1, others))


def build(listed: DataFrame, n: int, others: DataFrame, n_others: int) -> Cascade:
    """The cascade of ``n`` distinct keys ``listed (key)`` over them and about
    ``n_others`` other keys ``others (key)``, which may repeat and may hold
    listed keys."""
    levels: list[Level] = []
    inside, outside = listed, others
    while n:
        rate = 0.5 if levels else first_rate(n, n_others)
        level = encode(inside, n, rate, len(levels) + 1)
        only = Cascade((level,))
        passed = only.attach(outside, "_f").where(only.lists(F.col("key"), "_f")).select("key")
        # the corpus' keys come repeated and with the listed ones; later levels are sets already
        wrong = stage(passed if levels else passed.subtract(listed), "passed")
        levels.append(level)
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(tuple(levels))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``(key, blocked, labels, path_chars)`` of ``rules (verdict, host,
    path)``, each key once. Rules that fit no URL are left out: a null or empty
    host, a host with ``/ ? #``, a path that is neither empty nor starts with
    ``/`` or holds ``? #``, another verdict. A key in both lists is blocked."""
    host = F.translate(F.col("host").cast("string"), UPPER, LOWER)
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    fits = (F.col("verdict").isin(BLOCK, ALLOW) & host.rlike(r"^[^/?#]+$") & path.rlike(r"^(/[^?#]*)?$"))
    return (rules.where(F.coalesce(fits, F.lit(False)))
            .select(F.concat(host, path).alias("key"), (F.col("verdict") == BLOCK).alias("blocked"),
                    _labels(host).alias("labels"), F.char_length(path).alias("path_chars"))
            .groupBy("key", "labels", "path_chars").agg(F.max("blocked").alias("blocked")))


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys of the URL in columns ``host`` and ``path``, longest first."""
    host, path = F.col("host"), F.col("path")
    shape = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in shapes])
    fit = F.filter(shape, lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.char_length(path)))

    def key(s: Column) -> Column:
        end = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        text = F.concat(end, F.call_function("substring", path, F.lit(1), s["chars"]))
        return F.struct((-F.char_length(text)).alias("by"), s["chars"].alias("then"), text.alias("key"))

    keys = F.transform(F.array_sort(F.transform(fit, key)), lambda s: s["key"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def judge_urls(pages: DataFrame, rules: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` with columns ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the longest listed key that fits (of equally long ones that of
    the longer host), else null; ``verdict`` is the rule's, and "allow" for a
    URL that holds no listed key. A null URL, or one without ``://``, has empty
    host and path and holds no rule; an empty host neither. Rows are judged
    alone, so repeated rows repeat; only ``url`` is needed. The other columns
    stay, but for any that have the names of the four results, which go. Without
    rules every URL is allowed. Rule paths may have any lengths; the number of different
    shapes of rules, not of rules, is what the driver holds.
    """
    results = ("host", "path", "rule", "verdict")
    extra = [n for n in pages.columns if n.lower() not in results]
    keys = stage(rule_keys(rules), "rules")
    shapes = sorted((r["labels"], r["path_chars"]) for r in keys.select("labels", "path_chars").distinct().collect())
    rows = pages.select(F.struct(*[column(n) for n in extra]).alias("row"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    none = F.lit(None).cast("string")
    if not shapes:
        return _unfold(rows.select("row", "host", "path", none.alias("rule"), F.lit(ALLOW).alias("verdict")), extra)
    n_listed = keys.count()
    corpus = rows.select(F.explode(_keys(shapes)).alias("key"))
    n_corpus = corpus.agg(F.approx_count_distinct("key")).first()[0]
    groups = max(1, -(-level_size(n_listed, first_rate(n_listed, n_corpus))[0] // max(64, max_bits)))
    rows = rows.select("row", "host", "path", F.lit(None).cast("int").alias("place"))

    def of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups))

    for g in range(groups):
        mine = keys.select("key").where(of(F.col("key")) == g)
        cascade = build(mine, mine.count(), corpus.where(of(F.col("key")) == g), -(-n_corpus // groups))

        hits = F.transform("keys", lambda k, i: F.when((of(k) == g) & cascade.lists(k, "_listed"), i))
        rows = (cascade.attach(rows.withColumn("keys", _keys(shapes)), "_listed")
                .select("row", "host", "path", "keys", F.least("place", F.array_min(hits)).alias("place")))
        if groups > 1:
            rows = stage(rows.drop("keys"), "judged").withColumn("keys", _keys(shapes))
    rows = rows.select("row", "host", "path", F.get("keys", F.col("place")).alias("rule"))
    blocked, allowed = keys.where("blocked").select("key"), keys.where(~F.col("blocked")).select("key")
    n_blocked = blocked.count()
    # blocked among all listed keys: sized by the listed keys, so by no more groups than above
    tell = build(blocked, n_blocked, allowed, n_listed - n_blocked) if n_blocked else Cascade(())
    verdict = F.when(F.col("rule").isNotNull() & tell.lists(F.col("rule"), "_blocked"), BLOCK).otherwise(ALLOW)
    return _unfold(tell.attach(rows, "_blocked").select("row", "host", "path", "rule", verdict.alias("verdict")), extra)


def _unfold(rows: DataFrame, extra: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(n).alias(n) for n in extra], "host", "path", "rule", "verdict")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` against the fixed rules."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_FITS = """(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"""

#: The same judgement as a join of every URL with the rules.
OP13_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE {_FITS}) AS rule,
       COALESCE((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE {_FITS}), 'allow') AS verdict
FROM p
"""
