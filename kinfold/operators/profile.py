"""Source profiles: missing values, uniqueness, country distribution, length statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import NULL_WORDS, raw_word_count

FIELDS = ("business_name", "business_address", "country")


def cleaned(entities: DataFrame) -> DataFrame:
    """Words for a missing value as null."""
    return entities.withColumns({c: F.when(~F.col(c).isin(*NULL_WORDS), F.col(c)) for c in FIELDS})


def _stats(value: F.Column, name: str) -> list[F.Column]:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [
        F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std"), F.min(value).cast("long").alias(f"{name}_min"),
        p[0].alias(f"{name}_median"), p[1].alias(f"{name}_p95"), p[2].alias(f"{name}_p99"), F.max(value).cast("long").alias(f"{name}_max"),
    ]


def profile(entities: DataFrame) -> DataFrame:
    """A row per source.  Missing texts have length 0; duplicates are non-missing minus distinct."""
    rows = cleaned(entities)
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    rows = rows.withColumns({"_nl": F.length(name), "_nw": raw_word_count(name), "_al": F.length(addr), "_aw": raw_word_count(addr)})
    out = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("entity_id", *FIELDS)]]
    for c, n in (("entity_id", "entity_ids"), ("business_name", "names"), ("business_address", "addresses")):
        out += [F.count_distinct(F.col(c)).alias(f"unique_{n}"), (F.count(F.col(c)) - F.count_distinct(F.col(c))).alias(f"duplicate_{n}")]
    for c, n in (("_nl", "name_char_len"), ("_nw", "name_word_cnt"), ("_al", "addr_char_len"), ("_aw", "addr_word_cnt")):
        out += _stats(F.col(c), n)
    return rows.groupBy("src").agg(*out)


def country_distribution(entities: DataFrame) -> DataFrame:
    """Rows per source and country, null included, with the share of the source; most frequent first."""
    counts = cleaned(entities).groupBy("src", "country").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("src").agg(F.sum("rows").alias("_all"))
    shares = counts.join(totals, "src").withColumn("share", F.col("rows").cast("double") / F.col("_all").cast("double"))
    return shares.drop("_all").orderBy("src", F.desc("rows"), "country")
