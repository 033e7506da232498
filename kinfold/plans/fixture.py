"""The linkage inputs as a view over the driver's ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", " Inc.", " Pvt Ltd", " & Co", " Group")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        src.alias("src"),
        F.col("doc_id").alias("row_idx"),
        F.concat(src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.concat(F.substring(F.substring_index("text", "\n", 1), 1, 60), suffix).alias("business_name"),
        F.concat((F.col("n_chars") % 1000).cast("string"), F.lit(" "), F.right("text", F.lit(40))).alias("business_address"),
        F.col("lang").alias("country"),
    )


def _tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    return d.select(src.alias("src"), F.concat(src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.col("doc_id").alias("row_idx"), F.coalesce("lang", F.lit("")).alias("lang"), F.right("text", F.lit(80)).alias("tail"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_idx, source1_entity_id, matched_entity_ids``: records with the same language and the same last 80
    characters match.  One list per (language, tail), joined to the S1 records of that key."""
    t = _tails(spark, sf_dir)
    lists = t.where("src <> 'S1'").groupBy("lang", "tail").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))
    s1 = t.where("src = 'S1'").join(lists, ["lang", "tail"], "left")
    return s1.select("row_idx", F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
