"""Small hard inputs: nulls, empty and very long texts, ties, repeated rows,
extra columns whose names clash with the operators' own."""

import random

COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, size int, "
           "rows int, s int, node bigint, line string, doc int, bin int, copies int, bucket int, row string, `od d` int, `a.b` string, `t``x` int")

WORDS = ("the of and a to in is der die und le la de el los river stone cloud engine silver garden winter paper "
         "bridge lantern mountain harbour copper velvet thunder meadow compass orchard whisper anchor").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows(seed=3):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(30)]
    long_text = "\n".join(sentence(rng, 40) for _ in range(120))
    near = long_text.replace(" river ", " rivers ", 2)
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [
        (100, long_text, "en", "src1", len(long_text)), (101, near, "en", None, len(near)),
        (102, texts[0], "en", "src0", None), (102, texts[0], "en", "src0", None),       # repeated row
        (103, None, None, None, None), (104, "", "de", "src2", 0), (105, " \n\t ", "de", "src2", 4),
        (None, texts[1], "en", "src3", 5), (None, None, None, None, None),
        (106, "Ünïcödé <|endoftext|> “quotes” 漢字 🙂 don't", "fr", "é", 1), (107, "word", "fr", "é", 4),
        (-5, texts[2] + "\r\n" + texts[3], "es", "src1", 9),
    ]
    return [(*r, 7, "k", 1, 2, 3, 4, "l", 5, 6, 7, 8, "r", 9, "dot", 2) for r in rows]


def hard_docs(spark, seed=3):
    return spark.createDataFrame(hard_rows(seed), COLUMNS)


def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
