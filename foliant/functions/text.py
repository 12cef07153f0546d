"""Cleaning and segmentation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What cleaning removes, in order, and what it puts in place. ``(?d)`` makes a newline the only line end.
CLEANING = (
    (r"(?is)Enlarge this image.*?AP", ""),
    (r"(?id)toggle caption.*?AP", ""),
    (r"(?d)\[.*?\]", ""),
    (r" +", " "),
    (r"\n\n+", "\n\n"),
)
ARTICLE_SEPARATOR = r"\|\|\|"
SENTENCE_BREAK = r"(?<=[.!?])(?U)\s+"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def clean_text(c: Column) -> Column:
    for pattern, to in CLEANING:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: F.length(x) > 0)


def let(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, also inside a lambda, where Spark doesn't share common expressions."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def split_articles(c: Column, separator: str = ARTICLE_SEPARATOR) -> Column:
    """The articles of a cluster; if none is left, the stripped text alone."""
    return let(_parts(c, separator), lambda kept: F.when(F.size(kept) == 0, F.array(strip(c))).otherwise(kept))


def split_paragraphs(c: Column) -> Column:
    return let(_parts(c, "\n\n"), lambda kept: F.when(F.size(kept) == 0, F.array(strip(c))).otherwise(kept))


def split_sentences(c: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before white space; a model-based splitter can take this function's place."""
    return _parts(c, SENTENCE_BREAK)


def truncate_chars(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def preview(c: Column, n: int = 500) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def or_placeholder(c: Column, word: str) -> Column:
    return F.when(is_blank(c), F.lit(f"Empty {word}")).otherwise(c)
