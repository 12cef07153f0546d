"""White-space tokens: the default tokenizer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def tokens(c: Column) -> Column:
    return F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda x: x != "")


def token_count(c: Column, specials: int = 0) -> Column:
    """Tokens, and the special ones that an encoding adds."""
    return F.size(tokens(c)) + specials


def decode(ids: Column) -> Column:
    return F.array_join(ids, " ")


def lead(c: Column, n: int | Column, source: int = 1024) -> Column:
    """The first ``n`` of the first ``source`` tokens: the default generator."""
    return decode(F.slice(F.slice(tokens(c), F.lit(1), F.lit(source)), F.lit(1), n if isinstance(n, Column) else F.lit(n)))


def truncate_tokens(c: Column, max_tokens: int = 200, max_chars: int = 800) -> Column:
    return F.substring(decode(F.slice(tokens(c), 1, max_tokens)), 1, max_chars)


def token_hash(tok: Column) -> Column:
    """32 bits that any engine can compute: the head of the token's md5."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
