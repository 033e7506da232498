"""The 27 features of a pair, computed once per record where that is possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import CHANNELS
from kinfold.functions import similarity as S
from kinfold.functions.text import numbers
from kinfold.operators.blocking import with_keys

#: Names and order of the features.
FEATURES = (
    "country_match", "is_s3", "name_jaccard", "name_overlap_min", "name_token_intersection", "name_3gram_jaccard", "name_seq_ratio",
    "first_char_match", "prefix_3_match", "name_len_diff", "name_len_ratio", "s1_has_addr", "cand_has_addr", "both_has_addr",
    "addr_jaccard", "addr_overlap_min", "addr_seq_ratio", "num_exact_match", "num_jaccard", "addr_len_diff", "addr_len_ratio",
    "p_exact", "p_sort", "p_f2", "p_addr", "p_rare", "p_channel_count",
)


def entity_features(entities: DataFrame) -> DataFrame:
    """Everything a pair needs of one record: a struct ``f`` by ``entity_id``."""
    k = with_keys(entities)
    has = (F.col("norm_addr") != "") & (F.col("norm_addr") != "none")
    parts = {
        "country": F.coalesce("country", F.lit("")),
        "name": F.col("norm_name"),
        "name_set": F.array_distinct("name_tokens"),
        "name_grams": S.char_ngrams(F.col("norm_name")),
        "name_letters": S.letter_counts(F.col("norm_name")),
        "addr": F.col("norm_addr"),
        "has_addr": has,
        "addr_set": F.array_distinct("addr_tokens"),
        "addr_letters": S.letter_counts(F.col("norm_addr")),
        "first_number": F.get(numbers(F.col("business_address")), F.lit(0)),
        "number_set": F.array_distinct(numbers(F.col("business_address"))),
        "sorted_name": F.col("sorted_name"),
        "first2_name": F.col("first2_name"),
        "addr_key": F.col("addr_num_street"),
        "core_set": F.array_distinct("core_tokens"),
    }
    return k.select("entity_id", F.struct(*[v.alias(n) for n, v in parts.items()]).alias("f"))


def feature_columns(provenance: dict[str, Column] | None = None) -> dict[str, Column]:
    """Features over structs ``a`` (S1) and ``b`` (candidate) and the id ``cand_id``.

    ``provenance``: 0/1 columns by channel; by default a channel counts where both records have the same key, caps and
    country disregarded, and the rare-token channel where they share any core token.
    """
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    nj = S.jaccard(a("name_set"), b("name_set"))
    gj = S.jaccard(a("name_grams"), b("name_grams"))
    both = a("has_addr") & b("has_addr")
    aj = S.jaccard(a("addr_set"), b("addr_set"))
    at = lambda c: F.when(both, c).otherwise(F.lit(0.0))
    same = lambda n: S.flag((a(n) != "") & (a(n) == b(n)))
    if provenance is None:
        shares = S.flag(F.arrays_overlap(a("core_set"), b("core_set")))
        provenance = dict(zip(CHANNELS, (same("name"), same("sorted_name"), same("first2_name"), same("addr_key"), shares), strict=True))
    p = [F.coalesce(provenance[c].cast("double"), F.lit(0.0)) if c in provenance else F.lit(0.0) for c in CHANNELS]
    name_seq = F.when((gj == 0) & (nj == 0), 0.0).otherwise(S.letter_bag_ratio(a("name"), b("name"), a("name_letters"), b("name_letters")))
    addr_seq = F.when(aj == 0, 0.0).otherwise(S.letter_bag_ratio(a("addr"), b("addr"), a("addr_letters"), b("addr_letters")))
    prefix = (F.length(a("name")) >= 3) & (F.length(b("name")) >= 3) & (F.left(a("name"), F.lit(3)) == F.left(b("name"), F.lit(3)))
    values = [
        same("country"),
        S.flag(F.startswith(F.col("cand_id"), F.lit("S3-"))),
        nj,
        S.overlap_of_smaller(a("name_set"), b("name_set")),
        S.overlap_count(a("name_set"), b("name_set")).cast("double"),
        gj,
        name_seq,
        S.flag((a("name") != "") & (F.left(a("name"), F.lit(1)) == F.left(b("name"), F.lit(1)))),
        S.flag(prefix),
        F.abs(F.length(a("name")) - F.length(b("name"))).cast("double"),
        S.length_ratio(a("name"), b("name")),
        S.flag(a("has_addr")),
        S.flag(b("has_addr")),
        S.flag(both),
        at(aj),
        at(S.overlap_of_smaller(a("addr_set"), b("addr_set"))),
        at(addr_seq),
        at(S.flag(a("first_number") == b("first_number"))),
        at(S.jaccard(a("number_set"), b("number_set"))),
        at(F.abs(F.length(a("addr")) - F.length(b("addr"))).cast("double")),
        at(S.length_ratio(a("addr"), b("addr"))),
        *p,
        sum(p[1:], p[0]),
    ]
    return dict(zip(FEATURES, values, strict=True))


def pair_features(pairs: DataFrame, records: DataFrame, *, from_channels: bool = False) -> DataFrame:
    """Features of ``pairs`` (``s1_id, cand_id, ...``) from :func:`entity_features`.

    ``from_channels``: provenance is what candidate generation recorded in ``channels``.
    """
    joined = pairs.join(records.select(F.col("entity_id").alias("s1_id"), F.col("f").alias("a")), "s1_id")
    joined = joined.join(records.select(F.col("entity_id").alias("cand_id"), F.col("f").alias("b")), "cand_id")
    flags = {c: F.array_contains("channels", c).cast("int") for c in CHANNELS} if from_channels else None
    return joined.select(*pairs.columns, *[v.alias(n) for n, v in feature_columns(flags).items()])
