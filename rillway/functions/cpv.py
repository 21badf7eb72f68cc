"""Algebra of hierarchical codes of eight digits (division, group, class, category by 2, 4, 6, 8 digits)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict(code: Column) -> Column:
    """A code that has exactly eight digits once blanks are trimmed; else null."""
    return F.when(F.trim(code).rlike(r"^\d{8}$"), F.trim(code))


def prefix8(code: Column) -> Column:
    """First eight of the digits of a text; null if there are fewer."""
    digits = F.regexp_replace(code, r"\D", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8))


def level(a: Column, b: Column) -> Column:
    """Digits of the longest common prefix of even length: 0, 2, 4, 6 or 8; null if a code is missing."""
    same = lambda n: F.substring(a, 1, n) == F.substring(b, 1, n)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 8).when(same(6), 6).when(same(4), 4).when(same(2), 2).otherwise(0)


def match_score(a: Column, b: Column) -> Column:
    return level(a, b) / F.lit(8.0)


def distance(a: Column, b: Column) -> Column:
    """0 for the same code, two steps for every level below the common one, 8 across divisions."""
    n = level(a, b)
    return F.when(n == 8, 0).when(n == 0, 8).otherwise((8 - n).cast("int"))


def inferred_parent(code: Column) -> Column:
    """The code with its last digit that isn't zero put to zero, never above two digits; null for divisions."""
    head = F.regexp_replace(code, "0+$", "")
    n = F.greatest(F.length(head), F.lit(2))
    up = F.rpad(F.substr(code, F.lit(1), n - 1), 8, "0")
    return F.when(n > 2, up)


def ancestors(code: Column) -> Column:
    """All inferred ancestors from the nearest to the division, without the code itself: its shorter prefixes of two digits and more, each once."""
    n = F.length(F.regexp_replace(code, "0+$", ""))
    widths = F.when(n > 2, F.sequence(n - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(widths, lambda w: F.rpad(F.substr(code, F.lit(1), w), 8, "0")))


def best_level(code: Column, gold: Column) -> Column:
    """Largest common level with any of an array of codes."""
    return F.array_max(F.transform(gold, lambda g: level(code, g)))


def zero_padded(code: Column, digits: int) -> Column:
    return F.rpad(F.substring(code, 1, digits), 8, "0")


def code_level(code: Column) -> Column:
    """Digits of the first of the widths 2, 4, 6, 8 whose zero-padded prefix is the code; 0 for what is no code of eight digits."""
    c = strict(code)
    return F.when(c.isNull(), 0).when(c == zero_padded(c, 2), 2).when(c == zero_padded(c, 4), 4).when(c == zero_padded(c, 6), 6).otherwise(8)
