"""Tokens and spelling for catalogue search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)?"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def one_edit(a: Column, b: Column) -> Column:
    """Equal; two neighbouring letters exchanged; or one letter more or less, from three letters on and with the same first two.

    One letter in place of another doesn't count.
    """
    la, lb = F.length(a), F.length(b)
    # Exchanged neighbours: the lengths are equal and removing what both begin and end with leaves two letters, reversed.
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    swapped = F.concat(F.substr(a, F.lit(1), at - 1), F.substr(a, at + 1, F.lit(1)), F.substr(a, at, F.lit(1)), F.substr(a, at + 2))
    exchange = (la == lb) & at.isNotNull() & (at < la) & (swapped == b)
    insert = (F.abs(la - lb) == 1) & (F.least(la, lb) >= 3) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)) & (F.levenshtein(a, b) == 1)
    return F.coalesce((a == b) | exchange | insert, F.lit(False))
