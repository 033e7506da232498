"""Candidate generation: five blocking channels, capped per key, in one equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.config import ADDRESS, CHANNELS, EXACT, FIRST2, RARE, SORTED, LinkageConfig
from kinfold.functions import keys as K
from kinfold.functions import text as X

RECORD = ("src", "row_idx", "entity_id", "country")


def with_keys(entities: DataFrame) -> DataFrame:
    """Normalised fields and the keys that need nothing but the record itself."""
    norm = entities.withColumns({"norm_name": X.normal_name(F.col("business_name")), "norm_addr": X.normal_text(F.col("business_address"))})
    split = norm.withColumns({"name_tokens": X.tokens(F.col("norm_name")), "addr_tokens": X.tokens(F.col("norm_addr"))})
    n, a = F.col("name_tokens"), F.col("addr_tokens")
    return split.withColumns({
        "sorted_name": K.sorted_key(n),
        "first2_name": K.first_two_key(n),
        "addr_num_street": K.number_street_key(a),
        "core_tokens": K.core_tokens(n),
    })


def token_frequency(keyed: DataFrame) -> DataFrame:
    """How many S2 and S3 records have each core token, all countries together."""
    others = keyed.where(F.col("src") != "S1")
    return others.select(F.explode(F.array_distinct("core_tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def rarest_tokens(keyed: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each record's rarest core token (first of equals) and its frequency; unseen tokens count as 0."""
    each = keyed.select(*RECORD, F.posexplode("core_tokens").alias("pos", "token"))
    known = each.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = F.min(F.struct("df", "pos", "token"))
    return known.groupBy(*RECORD).agg(best.alias("b")).select(*RECORD, F.col("b.token").alias("token"), F.col("b.df").alias("df"))


def channel_keys(keyed: DataFrame, config: LinkageConfig | None = None, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Long form ``src, row_idx, entity_id, country, channel, key``; a missing country is joinable, a missing key is not."""
    config = config or LinkageConfig()
    own = {EXACT: "norm_name", SORTED: "sorted_name", FIRST2: "first2_name", ADDRESS: "addr_num_street"}
    pairs = [F.struct(F.lit(c).alias("channel"), F.col(own[c]).alias("key")) for c in channels if c in own]
    base = keyed.withColumn("country", F.coalesce("country", F.lit("")))
    out = None
    if pairs:
        out = base.select(*RECORD, F.explode(F.array(*pairs)).alias("k")).select(*RECORD, "k.channel", "k.key").where(F.col("key") != "")
    if RARE in channels:
        rare = rarest_tokens(base, token_frequency(keyed)).where(F.col("df") <= config.df_ceiling).select(*RECORD, F.lit(RARE).alias("channel"), F.col("token").alias("key"))
        out = rare if out is None else out.unionByName(rare)
    return out


def capped(keys: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first rows of each (source, country, channel, key) in row order.  The bound by the largest cap is a
    literal, so Spark drops the rest of a hot key before the shuffle."""
    order = Window.partitionBy("src", "country", "channel", "key").orderBy("row_idx", "entity_id")
    cap = F.coalesce(*[F.when(F.col("channel") == c, F.lit(n)) for c, n in caps.items()])
    ranked = keys.where(F.col("src") != "S1").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max(caps.values())).where(F.col("rank") <= cap)


def channel_pairs(keys: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``s1_idx, s1_id, cand_idx, cand_id, channel``: S1 records with the capped records of the same key."""
    left = keys.where(F.col("src") == "S1").select("country", "channel", "key", F.col("row_idx").alias("s1_idx"), F.col("entity_id").alias("s1_id"))
    right = capped(keys, caps).select("country", "channel", "key", F.col("row_idx").alias("cand_idx"), F.col("entity_id").alias("cand_id"))
    return left.join(right, ["country", "channel", "key"]).select("s1_idx", "s1_id", "cand_idx", "cand_id", "channel")


def union_candidates(pairs: DataFrame) -> DataFrame:
    """Each pair once, with the channels that found it."""
    return pairs.groupBy("s1_idx", "s1_id", "cand_idx", "cand_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


class CandidateGenerator:
    """Multi-channel candidate generation with per-channel caps."""

    def __init__(self, config: LinkageConfig | None = None) -> None:
        self.config = config or LinkageConfig()

    def generate(self, entities: DataFrame) -> DataFrame:
        keys = channel_keys(with_keys(entities), self.config)
        return union_candidates(channel_pairs(keys, self.config.caps))
