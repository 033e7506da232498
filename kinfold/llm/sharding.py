"""Jump consistent hashing: stable keys to shards without a ring table, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757
LIMB = 22
MASK = (1 << LIMB) - 1


def _step(state: Column) -> Column:
    """One draw: ``key = key * MULTIPLIER + 1 (mod 2**64)`` in three limbs (22, 22 and 20 bits), so that ANSI
    arithmetic cannot overflow; then the next bucket the key would move to."""
    m0, m1, m2 = MULTIPLIER & MASK, (MULTIPLIER >> LIMB) & MASK, MULTIPLIER >> (2 * LIMB)
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    r0 = k0 * F.lit(m0) + F.lit(1)
    r1 = k0 * F.lit(m1) + k1 * F.lit(m0) + F.shiftright(r0, LIMB)
    r2 = k0 * F.lit(m2) + k1 * F.lit(m1) + k2 * F.lit(m0) + F.shiftright(r1, LIMB)
    n1, n2 = r1.bitwiseAND(F.lit(MASK)), r2.bitwiseAND(F.lit((1 << 20) - 1))
    high = F.shiftleft(n2, 11) + F.shiftright(n1, 11)  # key >>> 33
    jump = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (high + F.lit(1)).cast("double"))).cast("long")
    return F.struct(r0.bitwiseAND(F.lit(MASK)).alias("k0"), n1.alias("k1"), n2.alias("k2"), state["j"].alias("b"), jump.alias("j"))


def jump_shards(key: Column, *counts: int) -> Column:
    """Struct of one shard per entry of ``counts`` (fields ``s0``, ``s1``, ...) for a 64-bit key.

    A key's buckets form one rising sequence that no shard count alters; its shard among ``n`` is the last
    entry below ``n``.  One fold therefore serves several counts, and going from ``n`` to ``n + 1`` shards moves
    rows only into the new one.  A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        key.bitwiseAND(F.lit(MASK).cast("long")).alias("k0"),
        F.shiftrightunsigned(key, LIMB).bitwiseAND(F.lit(MASK).cast("long")).alias("k1"),
        F.shiftrightunsigned(key, 2 * LIMB).bitwiseAND(F.lit((1 << 20) - 1).cast("long")).alias("k2"),
        F.lit(-1).cast("long").alias("b"),
        zero.alias("j"),
        *[zero.alias(f"s{i}") for i in range(len(counts))],
    )
    top = max(counts)

    def fold(acc: Column, _: Column) -> Column:
        nxt = _step(acc)
        kept = [F.when(acc["j"] < F.lit(n), acc["j"]).otherwise(acc[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)]
        moved = F.struct(*[nxt[c].alias(c) for c in ("k0", "k1", "k2", "b", "j")], *kept)
        return F.when(acc["j"] < F.lit(top), moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(top + 1)), start, fold, lambda acc: F.struct(*[acc[f"s{i}"].cast("int").alias(f"s{i}") for i in range(len(counts))]))


def number_within(df: DataFrame, group: str, order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group`` without one task per group: rows are numbered inside
    ``(group, bucket)``, and the buckets' counts, a table of groups x buckets, give each bucket's first number."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_first"))
    local = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    numbered = df.withColumn("_local", local)
    return numbered.join(firsts, (numbered[group] == firsts["_g"]) & (numbered["_bucket"] == firsts["_b"])).withColumn(out, (F.col("_first") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_g", "_b", "_first")


def shard_documents(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """Place every row into shards 0 to ``shards - 1`` by its key (law ``key``), and say where it would be with
    one shard more.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: 8), ``text_crc32`` that of the text (null: 0).  ``slot``
    numbers a shard's rows gaplessly in the order of a hash of key and text; rows that agree in both are alike and
    share the slots of their run in any order.  A null key counts as 0 for placement.  The text never crosses the
    shuffle: only its size and digest do.  Extra columns are ignored, an empty table gives an empty result.
    """
    raw = F.col(text).cast("binary")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        jump_shards(F.col(key), shards, shards + 1).alias("_at"),
        F.xxhash64(F.col(key), F.col(text)).alias("_h"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_at.s0").alias("shard"), F.col("_at.s1").alias("grown_shard"), "_h")
    order = [F.col("_h").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc()]
    numbered = number_within(placed, "shard", order, F.pmod(F.shiftright("_h", 40), F.lit(buckets)).cast("int"), "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
