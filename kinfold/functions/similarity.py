"""Similarities of sets and strings as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All that normalised text can hold.
ALPHABET = string.ascii_lowercase + string.digits + " "


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where one is empty."""
    both = overlap_count(a, b)
    return _ratio(both, F.size(a) + F.size(b) - both)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _ratio(overlap_count(a, b), F.least(F.size(a), F.size(b)))


def char_ngrams(x: Column, n: int = 3) -> Column:
    """Distinct character n-grams, spaces included; a shorter text is its own only one, the empty text has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(x) - (n - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(x, i, F.lit(n))))
    return F.when(x == "", F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(grams)


def letter_counts(x: Column) -> Column:
    """How often each symbol of ``ALPHABET`` occurs: once per record, so that a pair costs one fold."""
    return F.array(*[F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in ALPHABET])


def letter_bag_ratio(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """Twice the shared letters over all letters, order disregarded; 1 if equal, 0 if one is empty or less than a
    fifth as long as the other."""
    la, lb = F.length(a), F.length(b)
    shared = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    short = F.least(la, lb).cast("double") / F.greatest(la, lb, F.lit(1)).cast("double") < 0.2
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(short, 0.0).otherwise(_ratio(2 * shared, la + lb))


def length_ratio(a: Column, b: Column) -> Column:
    return _ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
