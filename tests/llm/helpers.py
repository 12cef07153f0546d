import re

import pyarrow.dataset as ds

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, words string, shard int"
#: Nulls in each column, empty and blank texts, ties, repeated rows, a long text, and columns whose names the operators use themselves.
ODD = [
    (1, "one two three four five six", "en", "a", 1, "x", "y", 1),
    (1, "one two three four five six", "en", "a", 1, "x", "y", 1),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "y", 1),
    (4, " \n\t ", "fr", "b", 3, "x", "y", 1),
    (None, "one two three four five six", "en", "b", 3, "x", "y", 1),
    (5, "word", None, None, 4, "x", "y", 1),
    (6, "the quick brown fox " * 6000, "en", "b", 9, "x", "y", 1),
    (7, "ÉÀ été. 12 ; 日本", "fr", None, 2, "x", "y", 1),
]


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def table(folder, name):
    return ds.dataset(f"{folder}/{name}.parquet").to_table().to_pylist()


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
