"""Fixtures shared by the tests of the training-data operators."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names the operators use inside or give out.
CLASHING = "kept key node digest sig size hash row score held_out n_words cleaned spans taken a b _row _kept_id place part raws".split()


def prose(seed: int, n: int) -> str:
    """Words without repeated windows, in sentences."""
    words = [f"w{(seed * 7919 + i * 31) % 99991}x{i}" for i in range(n)]
    return ". ".join(" ".join(words[i : i + 12]) for i in range(0, n, 12)) + "."


def rows():
    """Null and blank texts, a null id, repeated rows, copies, a very long text, odd characters."""
    long = prose(5, 30_000)
    texts = [
        (1, prose(1, 80)),
        (2, prose(1, 80)),
        (3, prose(1, 80).upper()),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "One  TWO\n"),
        (9, long),
        (10, long + " tail."),
        (None, prose(1, 80)),
        (None, None),
        (11, "é ü 日本 \u0000 😀 " + prose(11, 40)),
        (12, prose(12, 60)),
        (12, prose(12, 60)),
        (13, "same same same " * 40),
        (14, prose(1, 76) + " changed four last words."),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        out.append((doc, text, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if text is None else len(text)))
    return out


def frame(spark, data=None, clash=True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if clash:
        for name in CLASHING:
            df = df.withColumn(name, df["lang"])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
