"""Scalar text functions; white space and words are Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_words(text: Column) -> Column:
    """Runs of non-space that hold a word character."""
    return F.regexp_count(text, F.lit(r"(?U)\S*\w\S*"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def last_words(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - (n - 1), F.lit(1)), F.lit(n)), " ")


def sentences(text: Column) -> Column:
    """Split after . ? ! and at line ends; a final full stop goes, empty parts too."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(F.trim(s), r"\.+$", ""))
    return F.filter(parts, lambda s: s != "")
