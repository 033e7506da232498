"""Ground truth: pairs, statistics, match categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources.tables import id_list


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct ``s1_id, cand_id``."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list("matched_entity_ids")).alias("cand_id")).distinct()


def match_category(ids: Column) -> Column:
    s2, s3 = F.exists(ids, lambda x: F.startswith(x, F.lit("S2-"))), F.exists(ids, lambda x: F.startswith(x, F.lit("S3-")))
    return F.when(s2 & s3, "S2+S3").when(s2, "S2-only").when(s3, "S3-only").otherwise("None")


def truth_stats(truth: DataFrame) -> DataFrame:
    """One row.  Pairs count repeats here; a list of commas only is neither a singleton nor in a category."""
    ids = id_list("matched_entity_ids")
    t = truth.select((F.coalesce("matched_entity_ids", F.lit("")) == "").alias("single"), ids.alias("ids"), match_category(ids).alias("kind"))
    n = lambda p: F.size(F.filter("ids", lambda x: F.startswith(x, F.lit(p))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return t.agg(
        F.count(F.lit(1)).alias("total_s1"),
        F.count_if("single").alias("singletons"),
        F.count_if(~F.col("single")).alias("matched_s1"),
        F.count_if(F.col("kind") == "S2-only").alias("s2_only"),
        F.count_if(F.col("kind") == "S3-only").alias("s3_only"),
        F.count_if(F.col("kind") == "S2+S3").alias("s2_and_s3"),
        total(F.size("ids")).alias("total_pairs"),
        total(n("S2-")).alias("s2_pairs"),
        total(n("S3-")).alias("s3_pairs"),
        total(F.size(F.array_distinct("ids"))).alias("distinct_pairs"),
    ).withColumn("singleton_share", F.try_divide(F.col("singletons").cast("double"), F.col("total_s1").cast("double")))


def match_histogram(truth: DataFrame) -> DataFrame:
    return truth.select(F.size(id_list("matched_entity_ids")).alias("matches")).groupBy("matches").agg(F.count(F.lit(1)).alias("s1_records")).orderBy("matches")


def category_counts(truth: DataFrame) -> DataFrame:
    kinds = truth.select(match_category(id_list("matched_entity_ids", trim=True)).alias("match_type"))
    return kinds.groupBy("match_type").agg(F.count(F.lit(1)).alias("s1_records")).orderBy(F.desc("s1_records"), "match_type")


def sampled_examples(truth: DataFrame, order: DataFrame, entities: DataFrame, keys: int = 50, most: int = 30) -> DataFrame:
    """Of the first ``keys`` matched S1 records (``order``: ``s1_id, row_idx``) at most ``most`` examples with every
    matched record that is known."""
    matched = truth.where(F.coalesce("matched_entity_ids", F.lit("")) != "").select(F.col("source1_entity_id").alias("s1_id"), F.array_distinct(id_list("matched_entity_ids")).alias("ids"))
    head = matched.join(order, "s1_id").orderBy("row_idx").limit(keys)
    s1 = entities.where(F.col("src") == "S1").select(F.col("entity_id").alias("s1_id"), "country", F.col("business_name").alias("s1_name"))
    head = head.join(s1, "s1_id").orderBy("row_idx").limit(most)
    found = head.select("row_idx", "s1_id", "country", "s1_name", match_category(F.col("ids")).alias("match_category"), F.explode("ids").alias("cand_id"))
    record = entities.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("cand_name"), F.col("business_address").alias("cand_address"), F.col("country").alias("cand_country"))
    return found.join(record, "cand_id", "left").drop("row_idx")
