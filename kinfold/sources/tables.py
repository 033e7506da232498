"""Readers and writers: tab-separated record, truth and candidate files, Parquet data sets, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")
#: Words that the exploratory reader takes as missing.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, *names: str, na_words: bool = False) -> DataFrame:
    """A tab-separated file with a header, all columns strings.

    By default quotes are ordinary characters and an empty cell is the empty string; a row with too few cells is
    filled up.  With ``na_words`` cells may be quoted and the usual words for a missing value are null.
    """
    reader = spark.read.options(sep="\t", header=True, mode="PERMISSIVE", quote='"' if na_words else "", escape='"' if na_words else "\\").schema(_strings(*names))
    rows = reader.csv(path)
    if na_words:
        return rows.select(*[F.when(~F.col(n).isin(*NA_WORDS), F.col(n)).alias(n) for n in names])
    return rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


def read_source(spark: SparkSession, path: str, src: str, *, na_words: bool = False) -> DataFrame:
    """One record source with its tag and a row order (files in order, then lines)."""
    rows = read_tsv(spark, path, *RECORD, na_words=na_words)
    return rows.select(F.lit(src).alias("src"), F.monotonically_increasing_id().alias("row_idx"), *RECORD)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``source1_entity_id, matched_entity_ids`` with the words for a missing list as the empty list."""
    rows = read_tsv(spark, path, "source1_entity_id", "matched_entity_ids")
    ids = F.when(F.col("matched_entity_ids").isin("nan", "None", "<NA>"), F.lit("")).otherwise(F.col("matched_entity_ids"))
    return rows.select("source1_entity_id", ids.alias("matched_entity_ids"))


def id_list(column: str, trim: bool = False) -> F.Column:
    """The ids of a comma-joined list, empty ones dropped."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), ",")
    if trim:
        parts = F.transform(parts, F.trim)
    return F.filter(parts, lambda x: x != "")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """``s1_id, cand_id`` of a candidate file.  A missing file fails when it is planned."""
    rows = read_tsv(spark, path, "source1_entity_id", "candidate_entity_ids")
    return rows.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list("candidate_entity_ids")).alias("cand_id"))


def candidate_lists(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per S1 record, in row order, with its candidates joined by commas (empty if none)."""
    lists = candidates.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids"))
    joined = s1.select("row_idx", F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    return joined.select("row_idx", F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("candidate_entity_ids"))


def write_candidates(s1: DataFrame, candidates: DataFrame, path: str) -> None:
    rows = candidate_lists(s1, candidates).orderBy("row_idx").drop("row_idx")
    rows.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    """Pair features as Parquet, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
