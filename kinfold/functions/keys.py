"""Blocking keys as column expressions over normalised tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import STOP_WORDS


def significant(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def sorted_key(tokens: Column) -> Column:
    """All significant tokens in order of code points; all tokens where none is significant."""
    kept = significant(tokens)
    return F.array_join(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(tokens)), " ")


def first_two_key(tokens: Column) -> Column:
    """The first two significant tokens, sorted; empty where there is none."""
    return F.array_join(F.array_sort(F.slice(significant(tokens), 1, 2)), " ")


def _digits(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def number_street_key(tokens: Column) -> Column:
    """First number and first street word; two street words where there is no number."""
    nums = F.filter(tokens, _digits)
    words = F.filter(tokens, lambda t: ~_digits(t) & (F.length(t) > 2) & ~t.isin(*STOP_WORDS))
    first = F.concat_ws("_", F.get(nums, F.lit(0)), F.get(words, F.lit(0)))
    pair = F.concat_ws("_", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    return F.when((F.size(nums) > 0) & (F.size(words) > 0), first).when(F.size(words) >= 2, pair).otherwise(F.lit(""))


def zip_number_key(tokens: Column) -> Column:
    """The first two numbers of at least three digits."""
    return F.array_join(F.slice(F.filter(tokens, lambda t: _digits(t) & (F.length(t) >= 3)), 1, 2), "_")


def core_tokens(tokens: Column) -> Column:
    """Significant tokens of at least four characters, in order, with repeats."""
    return F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*STOP_WORDS))
