"""Blocking quality: recall, candidates per record, reduction; novelty against the exact-name channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import EXACT, SINGLE_CAPS
from kinfold.operators.blocking import capped


def hits(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates that are true pairs."""
    return candidates.join(pairs, ["s1_id", "cand_id"], "left_semi")


def source_sizes(entities: DataFrame) -> DataFrame:
    n1 = F.count_if(F.col("src") == "S1")
    return entities.agg(n1.alias("n_s1"), (n1 * F.count_if(F.col("src") != "S1")).alias("max_pairs"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds recall, candidates per S1 record and reduction to ``hits, gt_pairs, candidates, n_s1, max_pairs``."""
    d = lambda c: F.col(c).cast("double")
    return counts.withColumns({
        "recall": F.try_divide(d("hits"), d("gt_pairs")),
        "avg_candidates": F.try_divide(d("candidates"), d("n_s1")),
        "reduction": 1.0 - F.try_divide(d("candidates"), d("max_pairs")),
    })


def union_metrics(candidates: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    found = hits(candidates, pairs).agg(F.count(F.lit(1)).alias("hits")).scalar()
    true = pairs.agg(F.count(F.lit(1)).alias("gt_pairs")).scalar()
    size = source_sizes(entities)
    total = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    return rates(total.select("candidates", found.alias("hits"), true.alias("gt_pairs"), size.select("n_s1").scalar().alias("n_s1"), size.select("max_pairs").scalar().alias("max_pairs")))


def channel_metrics(keys: DataFrame, pairs: DataFrame, entities: DataFrame, caps: dict[str, int] | None = SINGLE_CAPS) -> DataFrame:
    """Each channel alone, without building its pairs.

    Candidates are sums over keys of the S1 records times the capped S2 and S3 records (repeats counted); hits come
    from the true pairs, joined to the keys of both ends.  ``caps`` None: uncapped.
    """
    group = ["country", "channel", "key"]
    left = keys.where(F.col("src") == "S1")
    right = keys.where(F.col("src") != "S1") if caps is None else capped(keys, caps)
    n1 = left.groupBy(*group).agg(F.count(F.lit(1)).alias("n1"))
    n2 = right.groupBy(*group).agg(F.count(F.lit(1)).alias("n2"))
    totals = n1.join(n2, group).groupBy("channel").agg(F.sum(F.col("n1") * F.col("n2")).alias("candidates"))
    ends = pairs.join(left.select(F.col("entity_id").alias("s1_id"), *group), "s1_id")
    met = ends.join(right.select(F.col("entity_id").alias("cand_id"), *group), ["cand_id", *group])
    found = met.groupBy("channel").agg(F.count(F.lit(1)).alias("hits"))
    size, true = source_sizes(entities), pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = keys.select("channel").distinct().join(totals, "channel", "left").join(found, "channel", "left")
    return rates(rows.select("channel", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("hits", F.lit(0)).alias("hits"), true.alias("gt_pairs"), size.select("n_s1").scalar().alias("n_s1"), size.select("max_pairs").scalar().alias("max_pairs")))


def novel_hits(candidates: DataFrame, pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """True candidates that the uncapped exact-name channel does not find."""
    exact = keys.where(F.col("channel") == EXACT)
    s1 = exact.where(F.col("src") == "S1").select(F.col("entity_id").alias("s1_id"), "country", "key")
    other = exact.where(F.col("src") != "S1").select(F.col("entity_id").alias("cand_id"), "country", "key")
    base = pairs.join(s1, "s1_id").join(other, ["cand_id", "country", "key"]).select("s1_id", "cand_id")
    return hits(candidates, pairs).join(base, ["s1_id", "cand_id"], "left_anti")


def recovered_examples(novel: DataFrame, entities: DataFrame, records: int = 15, matches: int = 3) -> DataFrame:
    """At most ``matches`` novel hits of each of the first ``records`` S1 records, with their fields."""
    head = novel.select("s1_idx", "s1_id").distinct().orderBy("s1_idx", "s1_id").limit(records)
    order = Window.partitionBy("s1_id").orderBy("cand_idx", "cand_id")
    some = novel.join(head.select("s1_id"), "s1_id", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= matches)
    a = entities.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_address"), "country")
    b = entities.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("cand_name"))
    return some.select("s1_id", "cand_id").join(a, "s1_id").join(b, "cand_id")
