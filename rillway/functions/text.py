"""Text expressions: tokens, normal forms, overlaps and grades, all built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Line ends unified, words broken at line ends joined before small letters, blanks and blank lines reduced, white space at both ends cut."""
    joined = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"-\n(?=[a-zäöüß])", "")
    even = F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n[ \t]+", "\n")
    return F.regexp_replace(F.regexp_replace(even, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def overlap(query: Column, text: Column) -> Column:
    """Share of the different query tokens that the text has; 0 if either has none."""
    q, t = F.array_distinct(query), F.array_distinct(text)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Score scaled into [0, 1]; if all are alike, 1 where they are positive, else 0."""
    return F.when(high - low < 1e-12, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded to so many digits by way of its scaled value, halves away from zero, as SQL engines do; Spark's own round goes by the shortest decimal, which puts what is within a rounding error of a half on the other side."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def hash_share(key: Column) -> Column:
    """Deterministic number in [0, 1] from a key: the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def confidence(score: Column) -> Column:
    """Scores in [0, 1] as they are, larger ones as x / (1 + x), negative ones as 0."""
    return F.when(score < 0, 0.0).when(score > 1, score / (1 + score)).otherwise(score)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
