"""Queries of the linkage engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import ADDRESS, CHANNELS, EXACT, FIRST2, RARE, SINGLE_CAPS, SORTED, LinkageConfig
from kinfold.functions import keys as K
from kinfold.functions import text as X
from kinfold.operators import blocking, dataset, evaluate, model, profile, truth
from kinfold.operators.pairs import FEATURES, entity_features, pair_features
from kinfold.plans import fixture, sql
from kinfold.plans.pipeline import Linkage
from kinfold.sources.tables import candidate_lists

#: Small bounds that bite on the test tables, so that caps and ceiling are checked by SQL too.
SMALL = LinkageConfig(caps={c: 5 for c in CHANNELS}, df_ceiling=40)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _sql[name] = oracle
        return f

    return put


def _linkage(s: SparkSession, d: str, config: LinkageConfig | None = None) -> Linkage:
    return Linkage(fixture.entities(s, d), fixture.truth(s, d), config or LinkageConfig())


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return blocking.with_keys(fixture.entities(s, d))


_add("entities", sql.with_(sql.ENT, select="SELECT * FROM ent"))(fixture.entities)


@_add("normalise_text", sql.with_(sql.ENT, sql.KEYED, select=f"SELECT entity_id, text_name, norm_name, norm_addr, {sql.address('business_address')} AS long_addr FROM keyed"))
def _normalise(s: SparkSession, d: str) -> DataFrame:
    e = fixture.entities(s, d)
    name, addr = F.col("business_name"), F.col("business_address")
    return e.select("entity_id", X.normal_text(name).alias("text_name"), X.normal_name(name).alias("norm_name"), X.normal_text(addr).alias("norm_addr"), X.normal_address(addr).alias("long_addr"))


@_add("blocking_keys", sql.with_(sql.ENT, sql.KEYED, select="SELECT entity_id, norm_name, sorted_name, first2_name, addr_num_street, zip_number, array_to_string(core, ' ') AS core FROM keyed"))
def _keys(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    return k.select("entity_id", "norm_name", "sorted_name", "first2_name", "addr_num_street", K.zip_number_key(F.col("addr_tokens")).alias("zip_number"), F.array_join("core_tokens", " ").alias("core"))


@_add("token_frequency", sql.with_(sql.ENT, sql.KEYED, sql.DF, select="SELECT token, df FROM tok"))
def _frequency(s: SparkSession, d: str) -> DataFrame:
    return blocking.token_frequency(_keyed(s, d))


@_add("rarest_token", sql.with_(sql.ENT, sql.KEYED, sql.DF, sql.RAREST, select="SELECT entity_id, token, df FROM rarest"))
def _rarest(s: SparkSession, d: str) -> DataFrame:
    k = _keyed(s, d)
    return blocking.rarest_tokens(k, blocking.token_frequency(k)).select("entity_id", "token", "df")


@_add("address_numbers", sql.with_(sql.ENT, select="SELECT entity_id, array_to_string(regexp_extract_all(business_address, '\\b[0-9]+\\b'), ' ') AS numbers FROM ent"))
def _numbers(s: SparkSession, d: str) -> DataFrame:
    return fixture.entities(s, d).select("entity_id", F.array_join(X.numbers(F.col("business_address")), " ").alias("numbers"))


def _channel(channel: str, config: LinkageConfig) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        keys = blocking.channel_keys(_keyed(s, d), config, (channel,))
        return blocking.channel_pairs(keys, {channel: config.caps[channel]}).select("s1_id", "cand_id", "channel")

    return run


for _name, _channel_name in (("exact", EXACT), ("sorted", SORTED), ("first2", FIRST2), ("address", ADDRESS), ("rare", RARE)):
    for _tail, _config in (("", LinkageConfig()), ("_small_caps", SMALL)):
        _text = sql.with_(*sql.union_parts(_config), select=f"SELECT s1_id, cand_id, channel FROM prs WHERE channel = '{_channel_name}'")
        _add(f"block_{_name}{_tail}", _text)(_channel(_channel_name, _config))


def _union(config: LinkageConfig) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = blocking.CandidateGenerator(config).generate(fixture.entities(s, d))
        return c.select("s1_idx", "s1_id", "cand_idx", "cand_id", F.array_join("channels", ",").alias("channels"))

    return run


_add("union_candidates", sql.with_(*sql.union_parts(), select="SELECT * FROM cand"))(_union(LinkageConfig()))
_add("union_candidates_small_caps", sql.with_(*sql.union_parts(SMALL), select="SELECT * FROM cand"))(_union(SMALL))


@_add("candidate_file", sql.with_(*sql.union_parts(), select="""SELECT row_idx, entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM ent
  LEFT JOIN (SELECT s1_id AS entity_id, array_to_string(list_sort(list(cand_id)), ',') AS ids FROM cand GROUP BY 1) USING (entity_id) WHERE src = 'S1'"""))
def _file(s: SparkSession, d: str) -> DataFrame:
    run = _linkage(s, d)
    return candidate_lists(run.entities.where("src = 'S1'"), run.candidates())


@_add("truth_pairs", sql.with_(sql.TRUTH, select="SELECT s1_id, cand_id FROM gt"))
def _truth(s: SparkSession, d: str) -> DataFrame:
    return truth.truth_pairs(fixture.truth(s, d))


@_add("truth_stats", sql.with_(sql.TRUTH, select=f"""SELECT count(*) AS total_s1, count(*) FILTER (len(ids) = 0) AS singletons, count(*) FILTER (len(ids) > 0) AS matched_s1,
  count(*) FILTER ({sql.KIND} = 'S2-only') AS s2_only, count(*) FILTER ({sql.KIND} = 'S3-only') AS s3_only, count(*) FILTER ({sql.KIND} = 'S2+S3') AS s2_and_s3,
  sum(len(ids))::BIGINT AS total_pairs, sum(k2)::BIGINT AS s2_pairs, sum(k3)::BIGINT AS s3_pairs, sum(len(list_distinct(ids)))::BIGINT AS distinct_pairs,
  count(*) FILTER (len(ids) = 0)::DOUBLE / count(*) AS singleton_share FROM kinds"""))
def _stats(s: SparkSession, d: str) -> DataFrame:
    return truth.truth_stats(fixture.truth(s, d))


@_add("match_histogram", sql.with_(sql.TRUTH, select="SELECT len(ids)::INT AS matches, count(*) AS s1_records FROM gl GROUP BY 1"))
def _histogram(s: SparkSession, d: str) -> DataFrame:
    return truth.match_histogram(fixture.truth(s, d))


@_add("match_categories", sql.with_(sql.TRUTH, select=f"SELECT {sql.KIND} AS match_type, count(*) AS s1_records FROM kinds GROUP BY 1"))
def _categories(s: SparkSession, d: str) -> DataFrame:
    return truth.category_counts(fixture.truth(s, d))


@_add("truth_examples", sql.with_(sql.ENT, sql.TRUTH, f"head AS (SELECT *, {sql.KIND} AS match_category FROM kinds WHERE len(ids) > 0 ORDER BY row_idx LIMIT 30)", select="""SELECT cand_id, s1_id, s.country, s.business_name AS s1_name, match_category,
  c.business_name AS cand_name, c.business_address AS cand_address, c.country AS cand_country FROM (SELECT s1_id, match_category, unnest(ids) AS cand_id FROM head) JOIN ent s ON s.entity_id = s1_id JOIN ent c ON c.entity_id = cand_id"""))
def _examples(s: SparkSession, d: str) -> DataFrame:
    t = fixture.truth(s, d)
    return truth.sampled_examples(t, t.select(F.col("source1_entity_id").alias("s1_id"), "row_idx"), fixture.entities(s, d))


def _profile_sql() -> str:
    words = lambda x: f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '[\\s\\x1c-\\x1f\\x0b\\x{{85}}\\p{{Z}}]+'), lambda t: t <> ''))"
    stats = []
    for x, n in (("nl", "name_char_len"), ("nw", "name_word_cnt"), ("al", "addr_char_len"), ("aw", "addr_word_cnt")):
        stats.append(f"round(avg({x}), 6) AS {n}_mean, round(stddev_pop({x}), 6) AS {n}_std, min({x})::BIGINT AS {n}_min, quantile_cont({x}::DOUBLE, 0.5) AS {n}_median, round(quantile_cont({x}::DOUBLE, 0.95), 6) AS {n}_p95, round(quantile_cont({x}::DOUBLE, 0.99), 6) AS {n}_p99, max({x})::BIGINT AS {n}_max")
    clean = ", ".join(f"CASE WHEN {c} NOT IN ('nan', 'None', '<NA>', '') THEN {c} END AS {c}" for c in profile.FIELDS)
    uniq = ", ".join(f"count(DISTINCT {c}) AS unique_{n}, count({c}) - count(DISTINCT {c}) AS duplicate_{n}" for c, n in (("entity_id", "entity_ids"), ("business_name", "names"), ("business_address", "addresses")))
    miss = ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in ("entity_id", *profile.FIELDS))
    return sql.with_(sql.ENT, f"cl AS (SELECT src, entity_id, {clean} FROM ent)", f"ln AS (SELECT *, length(coalesce(business_name, '')) AS nl, {words('business_name')} AS nw, length(coalesce(business_address, '')) AS al, {words('business_address')} AS aw FROM cl)", select=f"SELECT src, count(*) AS rows, {miss}, {uniq}, {', '.join(stats)} FROM ln GROUP BY src")


@_add("source_profile", _profile_sql())
def _profile(s: SparkSession, d: str) -> DataFrame:
    out = profile.profile(fixture.entities(s, d))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("_mean", "_std", "_p95", "_p99")) else F.col(c) for c in out.columns])


@_add("country_distribution", sql.with_(sql.ENT, select="SELECT src, country, count(*) AS rows, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS share FROM ent GROUP BY src, country"))
def _countries(s: SparkSession, d: str) -> DataFrame:
    return profile.country_distribution(fixture.entities(s, d))


@_add("baseline_metrics", sql.channel_metrics(None, "WHERE channel = 'exact_name'"))
def _baseline(s: SparkSession, d: str) -> DataFrame:
    return _linkage(s, d).baseline()


@_add("strategy_table", sql.channel_metrics(SINGLE_CAPS))
def _strategies(s: SparkSession, d: str) -> DataFrame:
    run = _linkage(s, d)
    return evaluate.channel_metrics(run.keys, run.truth, run.entities)


@_add("strategy_table_small_caps", sql.channel_metrics(SMALL.caps))
def _strategies_small(s: SparkSession, d: str) -> DataFrame:
    run = _linkage(s, d)
    return evaluate.channel_metrics(run.keys, run.truth, run.entities, SMALL.caps)


def _union_metrics(config: LinkageConfig) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        r = _linkage(s, d, config)
        return evaluate.union_metrics(r.candidates(), r.truth, r.entities)

    return run


_add("union_metrics", sql.union_metrics())(_union_metrics(LinkageConfig()))
_add("union_metrics_small_caps", sql.union_metrics(SMALL))(_union_metrics(SMALL))


@_add("candidate_counts", sql.with_(*sql.union_parts(), select="SELECT s1_id, count(*) AS candidates FROM cand GROUP BY s1_id"))
def _counts(s: SparkSession, d: str) -> DataFrame:
    return _linkage(s, d).candidates().groupBy("s1_id").agg(F.count(F.lit(1)).alias("candidates"))


@_add("novel_hits", sql.with_(*sql.union_parts(), sql.TRUTH, sql.NOVEL, select="SELECT s1_id, cand_id FROM novel"))
def _novel(s: SparkSession, d: str) -> DataFrame:
    r = _linkage(s, d)
    return evaluate.novel_hits(r.candidates(), r.truth, r.keys).select("s1_id", "cand_id")


@_add("recovered_examples", sql.with_(*sql.union_parts(), sql.TRUTH, sql.NOVEL, "heads AS (SELECT DISTINCT s1_idx, s1_id FROM novel ORDER BY 1, 2 LIMIT 15)", select="""SELECT s1_id, cand_id, a.business_name AS s1_name, a.business_address AS s1_address, a.country, b.business_name AS cand_name
  FROM (SELECT * FROM novel SEMI JOIN heads USING (s1_id) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY cand_idx, cand_id) <= 3) JOIN ent a ON a.entity_id = s1_id JOIN ent b ON b.entity_id = cand_id"""))
def _recovered(s: SparkSession, d: str) -> DataFrame:
    r = _linkage(s, d)
    return evaluate.recovered_examples(evaluate.novel_hits(r.candidates(), r.truth, r.keys), r.entities)


@_add("pair_features", sql.with_(*sql.union_parts(), sql.REC, select=f"SELECT s1_id, cand_id, {sql.features(False)} FROM cand {sql.FROM_PAIRS}"))
def _features(s: SparkSession, d: str) -> DataFrame:
    r = _linkage(s, d)
    return pair_features(r.candidates().select("s1_id", "cand_id"), entity_features(r.entities))


@_add("pair_features_provenance", sql.with_(*sql.union_parts(), sql.REC, select=f"SELECT s1_id, cand_id, channels, {sql.features(True)} FROM cand {sql.FROM_PAIRS}"))
def _features_flags(s: SparkSession, d: str) -> DataFrame:
    r = _linkage(s, d)
    out = pair_features(r.candidates().select("s1_id", "cand_id", "channels"), entity_features(r.entities), from_channels=True)
    return out.withColumn("channels", F.array_join("channels", ","))


@_add("pair_dataset", sql.sampled_features(f"SELECT s1_id AS source1_entity_id, cand_id AS candidate_entity_id, label, {', '.join(FEATURES)}, CASE WHEN {sql.VAL} THEN 'val' ELSE 'train' END AS split FROM feat"))
def _dataset(s: SparkSession, d: str) -> DataFrame:
    return _linkage(s, d).dataset()


@_add("split_counts", sql.with_(*sql.union_parts(), sql.TRUTH, sql.SAMPLE, select=f"""SELECT split, s1_records, coalesce(positives, 0) AS positives, coalesce(negatives, 0) AS negatives, positives::DOUBLE / nullif(negatives, 0) AS pos_neg_ratio
  FROM (SELECT CASE WHEN {sql.VAL} THEN 'val' ELSE 'train' END AS split, count(*) AS s1_records FROM gl GROUP BY 1)
  LEFT JOIN (SELECT CASE WHEN {sql.VAL} THEN 'val' ELSE 'train' END AS split, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM samp GROUP BY 1) USING (split)"""))
def _splits(s: SparkSession, d: str) -> DataFrame:
    r = _linkage(s, d)
    return dataset.split_counts(r.dataset(), r.entities)


@_add("threshold_sweep", sql.sampled_features(f"SELECT * FROM {sql.sweep('(SELECT label, name_jaccard AS prob FROM feat)')}"))
def _sweep(s: SparkSession, d: str) -> DataFrame:
    return model.threshold_sweep(_linkage(s, d).dataset(), "name_jaccard")


@_add("best_threshold", sql.sampled_features(f"SELECT coalesce(max(f05), 0.0)::DOUBLE AS best_f05, coalesce(arg_max(threshold, {{'f': f05, 's': -step}}), 0.5)::DOUBLE AS best_threshold FROM {sql.sweep('(SELECT label, name_jaccard AS prob FROM feat)')} WHERE f05 > 0"))
def _best(s: SparkSession, d: str) -> DataFrame:
    return model.best_threshold(model.threshold_sweep(_linkage(s, d).dataset(), "name_jaccard"))


@_add("roc_auc", sql.sampled_features("SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM (SELECT name_jaccard AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM feat GROUP BY 1))"))
def _auc(s: SparkSession, d: str) -> DataFrame:
    return model.roc_auc(_linkage(s, d).dataset(), "name_jaccard")


@_add("match_model")
def _model(s: SparkSession, d: str) -> DataFrame:
    return _linkage(s, d).summary()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
