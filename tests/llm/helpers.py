"""Odd documents and plain reference implementations for the tests of this folder."""

import re

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


#: Nulls in every column, empty and very long texts, equal texts, a repeated row and a repeated key.
ODD = [
    (1, "alpha beta gamma delta", "en", "a", 22),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "b", 4),
    (5, LONG, "la", "b", len(LONG)),
    (6, "alpha beta gamma delta", "en", None, 22),
    (6, "alpha beta gamma delta", "en", None, 22),
    (7, "Alpha  BETA\tgamma\ndelta", "en", "c", 22),
    (None, "a row without a key", None, "c", 19),
    (8, "é 日本語 \x00 ümlaut ÀÉ", "fr", "c", 10),
    (9, "x", "en", "c", 1),
    (10, LONG, "la", "b", len(LONG)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra=()):
    """The odd documents, with further constant columns of the given names."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    for name in extra:
        frame = frame.withColumn(name, F.lit("mine"))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(steps):
    """Two different words of 2**steps letters whose polynomial hashes modulo 2**64 are equal from ten steps on."""
    word = "a"
    for _ in range(steps):
        word = "".join("ab" if x == "a" else "ba" for x in word)
    return word, word.translate(str.maketrans("ab", "ba"))
