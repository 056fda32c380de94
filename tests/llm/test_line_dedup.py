import random

from pyspark.sql import functions as F

from stockbook.llm import line_dedup as L

from . import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """Texts by (doc_id, position) after comparing every line with all earlier ones."""
    where = sorted({(r[0] is None, r[0] or 0, no, line.strip(" \t\r")) for r in rows
                    for no, line in enumerate((r[1] or "").split("\n")) if line.strip(" \t\r")})
    first, gone = {}, set()
    for *at, line in where:
        if line in first:
            gone.add(tuple(at))
            continue
        if len(line) >= L.MIN_CHARS and any(len(o) >= L.MIN_CHARS and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2
                                            for o in first):
            gone.add(tuple(at))
        first[line] = at
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        keep = [x for no, x in enumerate(r[1].split("\n")) if (r[0] is None, r[0] or 0, no) not in gone]
        out.append((r[0], "\n".join(keep)))
    return out


def noisy_lines(seed=2):
    rng = random.Random(seed)
    base = [fixtures.sentence(rng, rng.randint(4, 9)) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x))
                x[k:k + rng.randint(0, 1)] = rng.choice(["", "é", "z", " "])
            lines.append("".join(x) + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    return rows


key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


def test_against_all_pairs(spark):
    rows = noisy_lines()
    got = [tuple(r) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    rows = noisy_lines(4)
    got = [tuple(r) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_hard_rows_and_nothing(spark):
    docs = fixtures.hard_docs(spark)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in fixtures.hard_rows()]), key=key)
    assert L.dedup_lines(fixtures.no_docs(spark)).count() == 0


def test_banded_distance_and_keys(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        x = "".join(rng.choice("abcdé ß") for _ in range(rng.randint(20, 50)))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(y))
            y[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "ß"])
        if abs(len(x) - len(y)) <= 2:
            pairs.append(tuple(sorted((x, "".join(y)), key=len)))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", L.edit_distance(F.col("x"), F.col("y")).alias("d"), F.levenshtein("x", "y").alias("l"),
                    F.bit_count(L.parity(F.col("x")).bitwiseXOR(L.parity(F.col("y")))).alias("p"),
                    F.arrays_overlap(L.index_keys(F.col("x"), F.length("x")), L.probe_keys(F.col("y"), F.length("y"))).alias("o"))
    for r in got.collect():
        assert min(r["d"], 3) == min(r["l"], 3)
        if r["l"] <= 2:
            assert r["o"] and r["p"] <= 4


def test_short_lines(spark):
    rows = [(1, "Les.\nAnd ornd.\nx\n\nabcdefghi"), (2, "Les.\nLet.\n \n\nAnd ornd."), (3, "x\nAnd ornde."),
            (4, "abcdefgXYi\nLes."), (5, "abcdefg\ny")]
    got = dict(tuple(r) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {1: rows[0][1], 2: "Let.\n \n", 3: "", 4: "", 5: "abcdefg\ny"}


def test_edit_join_of_short_lines_against_all_pairs(spark):
    rng = random.Random(7)
    lines = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(8, 13))) for _ in range(150)})
    rng.shuffle(lines)
    rows = [(d, "\n".join(lines[d::25])) for d in range(25)]
    got = [tuple(r) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert sum(len(t.split("\n")) for _, t in got if t) < len(lines)


def test_rows_that_share_an_id(spark):
    head, tail = "a heading that all of these rows have", "a closing line that is in some of them"
    texts = [f"{head}\nunique text of the first of the rows", f"{head}\nanother clean line, number two\n{tail}",
             f"{tail}\nthe third row talks of other things\n\nshort", "short\nsomething else entirely, row four"]
    for shared in (None, 7):
        rows = [(1, "an ordinary line of an ordinary row", 0)] + [(shared, t, i) for i, t in enumerate(texts)]
        rows += [(shared, texts[2], 9), (shared, texts[2], 9), (shared, None, 9)]
        out = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, n int")).collect()
        assert sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in rows)
        assert sum(r["text"] is None for r in out) == 1
        left = sorted(x for r in out for x in (r["text"] or "").split("\n") if x)
        assert left == sorted({x for _, t, _ in rows for x in (t or "").split("\n") if x})


def crowd_rows(seed):
    """One hot line in many near versions, lines that only share a passage, and
    a heading that stands everywhere."""
    rng = random.Random(seed)
    hot = fixtures.sentence(rng, 8)
    head, mid, tail = "all rights reserved by the ", fixtures.sentence(rng, 2), " (see the terms of use)"
    lines = []
    for i in range(150):
        x = list(hot)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(x))
            x[k:k + rng.randint(0, 1)] = rng.choice("abcxyz")
        lines.append("".join(x))
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 7)))
        lines.append(head + word + tail)
        lines.append(head + mid + " " + word)
    rng.shuffle(lines)
    return [(d, "A Heading\n" + "\n".join(lines[d::15])) for d in range(15)]


def test_crowded_keys_against_all_pairs(spark, monkeypatch):
    rows = crowd_rows(6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(brute(rows), key=key)
    for crowd in (1, 5, 64):
        monkeypatch.setattr(L.near_repeats, "__defaults__", (L.EDITS, crowd, None))
        assert sorted([tuple(r) for r in L.dedup_lines(docs).collect()], key=key) == want
    noisy = noisy_lines(9)
    monkeypatch.setattr(L.near_repeats, "__defaults__", (L.EDITS, 1, None))
    got = [tuple(r) for r in L.dedup_lines(spark.createDataFrame(noisy, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute(noisy), key=key)


def test_near_lines_of_one_hub_make_no_square(spark):
    """A crowd near its hub gives at most one pair a line and key."""
    lines = [f"a very common line of many documents, number {i:03d} of all" for i in range(400)]
    keyed = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(lines)], "doc bigint, h bigint, no int, line string")
    met = L.meeting(L.line_keys(keyed))
    crowds = met.where(F.col("rows") > L.CROWD)
    assert crowds.select("of").distinct().count() == 400
    assert 399 <= L._hubs(crowds.withColumnRenamed("of", "at")).count() <= 12 * 400


def test_hot_lines_get_keys_once(spark, monkeypatch):
    """A line in a third of all places, and near versions of it."""
    rng = random.Random(8)
    hot = "the line that stands in most documents of all"
    rows = []
    for d in range(140):
        lines = [hot, fixtures.sentence(rng, 5), hot if d % 2 else hot.replace("most", "mast")]
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    whole = L.line_keys
    monkeypatch.setattr(L, "line_keys", lambda lines, edits: seen.append(lines.count()) or whole(lines, edits))
    got = [tuple(r) for r in L.dedup_lines(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert seen == [142 + 69]       # of the hot line one; its version, 70 times, is not hot


def test_finer_keys_meet(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(500):
        x = "".join(rng.choice("abcdé ß") for _ in range(rng.randint(8, 30)))
        y = list(x)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(y) + 1)
            y[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "ß"])
        if len(y) >= 8:
            pairs.append(tuple(sorted((x, "".join(y)), key=len)))
    df = spark.createDataFrame(pairs, "x string, y string")
    index = lambda c: F.transform(F.filter(L.finer_keys(F.col(c), F.length(c)), lambda k: k["own"]), lambda k: k["key"])
    probe = F.transform(L.finer_keys(F.col("y"), F.length("y")), lambda k: k["key"])
    rows = df.select(F.levenshtein("x", "y").alias("l"), F.arrays_overlap(index("x"), probe).alias("o")).collect()
    assert all(r["o"] for r in rows if r["l"] <= 2) and sum(r["l"] <= 2 for r in rows) > 300


def test_finer_keys_are_one_small_expression(spark):
    df = spark.createDataFrame([("a line of some words", "x")], "line string, of string")
    keys = df.select("of", F.explode(L.finer_keys(F.col("line"), F.char_length("line"))).alias("k"))
    assert keys.select("k.key").count() == len(L._ways(L.EDITS, L.EDITS + 2))
    code = keys._jdf.queryExecution().debug().codegenToSeq().mkString()
    assert len(code) < 200_000
