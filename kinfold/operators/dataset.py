"""Leak-safe training data: labels, sampled negatives, split by S1 record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import LinkageConfig
from kinfold.operators.pairs import FEATURES, pair_features


def is_validation(s1_id: Column, modulus: int = 5) -> Column:
    """By the first 8 hex digits of the id's MD5, so all pairs of a record fall into one split."""
    return F.conv(F.substring(F.md5(s1_id.cast("binary")), 1, 8), 16, 10).cast("long") % modulus == 0


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    true = truth.select("s1_id", "cand_id", F.lit(1).alias("label"))
    return candidates.join(true, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def sampled(rows: DataFrame, negatives: int = 3) -> DataFrame:
    """All positives and the first negatives of each S1 record in row order."""
    order = Window.partitionBy("s1_id", "label").orderBy("cand_idx", "cand_id")
    ranked = rows.withColumn("_r", F.row_number().over(order))
    return ranked.where((F.col("label") == 1) | (F.col("_r") <= negatives)).drop("_r")


def build(candidates: DataFrame, truth: DataFrame, records: DataFrame, config: LinkageConfig | None = None) -> DataFrame:
    """``source1_entity_id, candidate_entity_id, label``, 27 features, ``split``."""
    config = config or LinkageConfig()
    pairs = sampled(labelled(candidates, truth), config.negatives).select("s1_id", "cand_id", "label")
    rows = pair_features(pairs, records)
    split = F.when(is_validation(F.col("s1_id"), config.split_modulus), "val").otherwise("train")
    return rows.select(F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), "label", *FEATURES, split.alias("split"))


def split_counts(rows: DataFrame, s1: DataFrame, config: LinkageConfig | None = None) -> DataFrame:
    """Records and pairs per split; a record without candidates still counts as one."""
    config = config or LinkageConfig()
    split = F.when(is_validation(F.col("entity_id"), config.split_modulus), "val").otherwise("train").alias("split")
    records = s1.where(F.col("src") == "S1").select("entity_id").distinct().groupBy(split).agg(F.count(F.lit(1)).alias("s1_records"))
    pairs = rows.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    out = records.join(pairs, "split", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("split", "s1_records", zero("positives").alias("positives"), zero("negatives").alias("negatives"))
    return out.withColumn("pos_neg_ratio", F.try_divide(F.col("positives").cast("double"), F.col("negatives").cast("double")))
