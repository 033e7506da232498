import difflib
import hashlib
import random

import pytest
from conftest import entities
from pyspark.sql import functions as F

from kinfold.config import ADDRESS, CHANNELS, EXACT, FIRST2, RARE, SORTED, LinkageConfig
from kinfold.functions import similarity as S
from kinfold.operators import blocking, dataset, evaluate, model, profile, truth
from kinfold.operators.pairs import FEATURES, entity_features, pair_features

ROWS = [
    ("S1-1", "Alpha Stone Ltd", "12 Main Rd", "US"),
    ("S1-2", "Beta Brook", "9 Oak Street", None),
    ("S1-3", "Gamma Unseen Zyx", "", "US"),
    ("S2-1", "Stone Alpha Inc", "12 Main Road", "US"),
    ("S2-2", "Alpha Stone", "77 Elm Way", "US"),
    ("S3-1", "Alpha Stone", "12 main rd", "FR"),
    ("S3-2", "beta brook", "9 oak street", ""),
    ("S3-3", "Gamma Group", None, "US"),
]


def found(df):
    return {(r.s1_id, r.cand_id): set(r.channels) for r in df.collect()}


def test_candidates(spark):
    got = found(blocking.CandidateGenerator().generate(entities(spark, ROWS)))
    assert got[("S1-1", "S2-1")] == {SORTED, FIRST2, ADDRESS}  # the first of equally rare tokens differs
    assert got[("S1-1", "S2-2")] == {EXACT, SORTED, FIRST2, RARE}
    assert ("S1-1", "S3-1") not in got  # other country
    assert got[("S1-2", "S3-2")] == set(CHANNELS)  # null and empty country join
    assert not any(a == "S1-3" for a, _ in got)  # the rarest token is one that nobody else has


def test_caps_take_the_first_rows_whatever_the_partitioning(spark):
    rows = [("S1-1", "Same Name", "", "US")] + [(f"S2-{i}", "Same Name", "", "US") for i in range(20)]
    config = LinkageConfig(caps={c: 3 for c in CHANNELS})
    df = entities(spark, rows)
    want = {("S1-1", f"S2-{i}") for i in range(3)}
    assert set(found(blocking.CandidateGenerator(config).generate(df))) == want
    assert set(found(blocking.CandidateGenerator(config).generate(df.repartition(7, F.rand(1))))) == want


def test_capped_rows_are_pruned_before_the_shuffle(spark):
    keys = blocking.channel_keys(blocking.with_keys(entities(spark, ROWS)))
    assert "WindowGroupLimit" in blocking.capped(keys, LinkageConfig().caps)._jdf.queryExecution().toString()


def test_df_ceiling_and_ties(spark):
    rows = [("S1-1", "aaaa bbbb", "", "US"), ("S2-1", "aaaa bbbb", "", "US"), ("S2-2", "aaaa cccc", "", "US")]
    keyed = blocking.with_keys(entities(spark, rows))
    rare = {r.entity_id: (r.token, r.df) for r in blocking.rarest_tokens(keyed, blocking.token_frequency(keyed)).collect()}
    assert rare == {"S1-1": ("bbbb", 1), "S2-1": ("bbbb", 1), "S2-2": ("cccc", 1)}
    low = blocking.channel_keys(keyed, LinkageConfig(df_ceiling=0), (RARE,))
    assert low.count() == 0


def test_config_must_name_all_channels():
    with pytest.raises(ValueError, match="caps lack"):
        LinkageConfig(caps={EXACT: 1})


def test_truth(spark):
    df = spark.createDataFrame([("S1-1", "S2-1,S3-1,S2-1"), ("S1-2", ""), ("S1-3", ","), ("S1-4", "S3-9"), ("S1-5", None)], "source1_entity_id string, matched_entity_ids string")
    r = truth.truth_stats(df).first()
    assert (r.total_s1, r.singletons, r.matched_s1, r.s2_only, r.s3_only, r.s2_and_s3, r.total_pairs, r.s2_pairs, r.s3_pairs, r.distinct_pairs) == (5, 2, 3, 0, 1, 1, 4, 2, 2, 3)
    assert {tuple(x) for x in truth.match_histogram(df).collect()} == {(0, 3), (1, 1), (3, 1)}
    assert truth.truth_pairs(df).count() == 3


def test_channel_metrics_count_as_pairs_would(spark):
    df = entities(spark, ROWS)
    keys = blocking.channel_keys(blocking.with_keys(df))
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-2"), ("S1-3", "S3-3")], "s1_id string, cand_id string")
    caps = {c: 1 for c in CHANNELS}
    made = blocking.channel_pairs(keys, caps)
    want = {r.channel: r["count"] for r in made.groupBy("channel").count().collect()}
    hit = {r.channel: r["count"] for r in evaluate.hits(made, pairs).groupBy("channel").count().collect()}
    for r in evaluate.channel_metrics(keys, pairs, df, caps).collect():
        assert (r.candidates, r.hits, r.gt_pairs, r.n_s1, r.max_pairs) == (want.get(r.channel, 0), hit.get(r.channel, 0), 3, 3, 15)
    u = evaluate.union_metrics(blocking.union_candidates(made), pairs, df).first()
    assert u.recall == u.hits / 3 and u.reduction == 1 - u.candidates / 15
    none = evaluate.union_metrics(blocking.union_candidates(made), pairs.limit(0), df).first()
    assert none.recall is None


def test_profile_of_missing_and_repeated(spark):
    df = entities(spark, [("S1-1", "a b", None, "US"), ("S1-1", "nan", "x", "None"), ("S1-2", "a b", "x y z", "US")])
    r = profile.profile(df).first()
    assert (r.rows, r.unique_entity_ids, r.missing_business_name, r.duplicate_names, r.missing_country, r.name_char_len_min, r.name_word_cnt_max, r.addr_word_cnt_max) == (3, 2, 1, 1, 1, 0, 2, 3)
    assert {(x.country, x.rows) for x in profile.country_distribution(df).collect()} == {("US", 2), (None, 1)}


def seq(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) / max(len(a), len(b)) < 0.2:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).quick_ratio()


def test_letter_bag_ratio_and_sets_are_exact(spark):
    rng = random.Random(9)
    some = ["".join(rng.choice("abc 1") for _ in range(rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(400)]
    pairs = [(i, rng.choice(some), rng.choice(some)) for i in range(500)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    grams = S.jaccard(S.char_ngrams(a), S.char_ngrams(b))
    rows = df.select("i", S.letter_bag_ratio(a, b, S.letter_counts(a), S.letter_counts(b)), grams).orderBy("i").collect()
    gram = lambda x: {x[k : k + 3] for k in range(len(x) - 2)} if len(x) >= 3 else ({x} if x else set())
    for (_, x, y), r in zip(pairs, rows, strict=True):
        assert r[1] == seq(x, y)
        g, h = gram(x), gram(y)
        assert r[2] == (len(g & h) / len(g | h) if g and h else 0.0)


def test_features(spark):
    df = entities(spark, ROWS)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-2"), ("S1-3", "S3-3")], "s1_id string, cand_id string")
    r = {x.cand_id: x for x in pair_features(pairs, entity_features(df)).collect()}
    a = r["S2-1"]
    assert [a.country_match, a.is_s3, a.name_jaccard, a.name_seq_ratio, a.first_char_match, a.p_exact, a.p_sort, a.p_rare, a.num_exact_match] == [1, 0, 1, 1, 0, 0, 1, 1, 1]
    assert a.addr_jaccard == 0.5 and a.p_channel_count == 4
    assert r["S3-2"].country_match == 0  # missing countries do not match
    assert [r["S3-3"].both_has_addr, r["S3-3"].addr_seq_ratio] == [0, 0]
    flags = spark.createDataFrame([("S1-1", "S2-1", [EXACT])], "s1_id string, cand_id string, channels array<string>")
    b = pair_features(flags, entity_features(df), from_channels=True).first()
    assert [b.p_exact, b.p_sort, b.p_channel_count] == [1, 0, 1]


def test_dataset_is_leak_safe_and_keeps_positives(spark):
    rows = [("S1-1", "Same Name", "", "US"), ("S1-2", "Same Name", "", "US")] + [(f"S2-{i}", "Same Name", "", "US") for i in range(9)]
    df = entities(spark, rows)
    true = spark.createDataFrame([("S1-1", "S2-7"), ("S1-1", "S2-8")], "s1_id string, cand_id string")
    out = dataset.build(blocking.CandidateGenerator().generate(df), true, entity_features(df)).collect()
    got = {(r.source1_entity_id, r.candidate_entity_id, r.label) for r in out}
    assert got == {("S1-1", "S2-7", 1), ("S1-1", "S2-8", 1)} | {(s, f"S2-{i}", 0) for s in ("S1-1", "S1-2") for i in range(3)}
    for r in out:
        assert (r.split == "val") == (int(hashlib.md5(r.source1_entity_id.encode()).hexdigest()[:8], 16) % 5 == 0)


def test_metrics(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, rng.choice([0.1, 0.35, 0.5, 0.62, 0.9])) for _ in range(300)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "label int, prob double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(model.roc_auc(df).first().auc - auc) < 1e-12
    best = (0.0, 0.5)
    for t in model.THRESHOLDS:
        tp, fp, fn = sum(p >= t for p in pos), sum(p >= t for p in neg), sum(p < t for p in pos)
        f = 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) if tp else 0.0
        if f > best[0]:
            best = (f, t)
    assert tuple(model.best_threshold(model.threshold_sweep(df)).first()) == best
    assert model.roc_auc(df.where("label = 1")).first().auc is None
    assert tuple(model.best_threshold(model.threshold_sweep(df.where("label = 0"))).first()) == (0.0, 0.5)


def test_model_learns(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        y = i % 2
        rows.append((f"S1-{i}", f"S2-{i}", y, *[float(y) * 0.5 + rng.random() * 0.3 if n == "name_jaccard" else 0.0 for n in FEATURES]))
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, label int, " + ", ".join(f"`{n}` double" for n in FEATURES))
    fitted = model.fit(df)
    assert model.roc_auc(model.score(fitted, df)).first().auc == 1.0
    assert model.top_weights(fitted)[0][0] == "name_jaccard"
