"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names; brute force."""

import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinfold.llm import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, pieces, sharding, suffix_dedup, token_planes, warc

tokenizer_files = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts(spark, rows):
    """Rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, n int").withColumns({"h": F.lit(1), "tag": F.lit("x"), "digest": F.lit(0)})


ODD = [(1, None), (2, ""), (3, "Ab c"), (3, "aB C"), (None, "ab c"), (5, "ab  c"), (6, "x " * 3000), (7, "é" * 5000), (8, "a\u0000b")]


# --- 1 ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "x" * 1000
    rows = [(1, None, None), (2, "u\r\nv", ""), (3, "a", long), (4, "é", long), (None, "b", long), (9, "c", long), (9, "c", long), (7, "s", "x" * 999), (8, "s", "x" * 999), (10, "r\n\r\n", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.warc_round_trip(pages).collect()
    assert len(got) == len(rows)
    body = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(body[r.page_id]), hashlib.sha1(body[r.page_id]).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body[r.page_id]
        assert (r.record_type, r.refers_to) == (("revisit", 9) if r.page_id in (3, 4, None) else ("response", None))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_normaliser_takes_any_members(tmp_path):
    recs = [warc.record(i, f"u{i}", b"p" * i, hashlib.sha1(b"p" * i).digest(), None, "2024-01-01T00:00:00Z") for i in range(5)]
    press = gzip.compress
    for raw in (press(b"".join(recs)), b"".join(map(press, recs)), press(b"".join(recs[:2])) + press(b"".join(recs[2:]))):
        p = tmp_path / "a.warc.gz"
        p.write_bytes(raw)
        with p.open("rb") as f:
            assert [w for _, _, w in warc.records(warc.inflated(f))] == recs


# --- 2 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000, token_planes.BLOCK + 3):
        ids = rng.integers(0, 1 << int(rng.integers(1, 32)), n).astype("<u4")
        assert (token_planes.unshuffle_planes(token_planes.shuffle_planes(ids, mode), n) == ids).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = texts(spark, [*ODD, (11, "it's 3² <|endoftext|> 日本\n\n  x"), (12, "a <|endoftext|> b<|endoftext|>"), (13, "<|endoftext")]).unionByName(documents(spark).select("doc_id", "text").withColumns({"n": F.lit(0), "h": F.lit(1), "tag": F.lit("x"), "digest": F.lit(0)}))
    got = token_planes.read_planes(token_planes.write_planes(docs, f"file://{tmp_path}/p", path, mode="bit")).collect()
    rows = sorted(((k, t or "") for k, t in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    at = 0
    for (k, t), r in zip(rows, sorted(got, key=lambda r: r.start), strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (k, at, len(ids), zlib.crc32(raw), raw)
        at += len(ids)
    assert token_planes.read_planes(token_planes.write_planes(docs.limit(0), f"file://{tmp_path}/e", path)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    """Also of a file whose rules differ, which goes to the tokenizer whole."""
    from tokenizers import Tokenizer

    path = tokenizer_files.path(name)
    for plain in (False, True):
        lib, own = Tokenizer.from_file(path), token_planes.Encoder(path, plain)
        lib.encode_special_tokens = plain
        assert own.shortcut == (name == "byte_bpe_50k.json")
        for text in ("", "a <|endoftext|> b", "The Cat's  hat,\n\n 12 é 日本", " <|startoftext|>x"):
            assert np.frombuffer(own.encode(text), own.kind).tolist() == lib.encode(text, add_special_tokens=False).ids


# --- 3 ---------------------------------------------------------------------------------------------------------


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark):
    rng = random.Random(4)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *(rng.getrandbits(63) for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), 24, 25, 1000).alias("s"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for k, s in df.collect():
        assert tuple(s) == (jump(k, 24), jump(k, 25), jump(k, 1000))


def test_shard_documents(spark):
    got = sharding.shard_documents(texts(spark, [*ODD, *((k, "same") for k in range(100, 400))]), 24).collect()
    assert len(got) == len(ODD) + 300
    for r in got:
        assert r.grown_shard in (r.shard, 24)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    one = {r.doc_id: r for r in got}
    assert (one[1].size, one[1].text_crc32, one[2].size) == (8, 0, 8)
    assert (one[7].size, one[7].text_crc32) == (10008, zlib.crc32(("é" * 5000).encode()))
    assert sharding.shard_documents(texts(spark, []), 24).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in language_id.op4_hyperdimensional_language(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (r in out) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_bundles_are_sums_of_bound_vectors():
    texts_ = ["the cat", "", "12", "Ñandú über", "a"]
    data, offsets = language_id.text_bytes(pa.array(texts_))
    got, letters = language_id.bundles(data, offsets)
    symbol, vec = language_id.tables()
    for i, t in enumerate(texts_):
        s = [int(symbol[ord(c)]) for c in t]
        s = [x for k, x in enumerate(s) if x or k == 0 or s[k - 1]]
        want = np.zeros(language_id.DIM)
        for k in range(len(s) - 2):
            want += np.roll(vec[s[k]], 0).astype(int) * np.roll(vec[s[k + 1]], 1) * np.roll(vec[s[k + 2]], 2)
        assert (got[i] == want).all() and letters[i] == sum(c.isalpha() for c in t)


def test_language_of_odd_texts(spark):
    profiles = language_id.fit(documents(spark))
    got = {r.doc_id: r for r in language_id.predict(texts(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the and of " * 400000)]), profiles).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4].lang_pred == "en"
    none = language_id.fit(documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(documents(spark), none).collect()} == {"und"}
    assert language_id.predict(texts(spark, []), profiles).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_streaming_dedup_agrees_with_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = {tuple(r) for r in duck.sql(exact_dedup.SQL).fetchall()}
    assert {tuple(r) for r in exact_dedup.op5_streaming_dedup(spark, DIR).collect()} == want


def test_streaming_dedup_of_odd_rows(spark):
    got = exact_dedup.streaming_dedup(texts(spark, [*ODD, (9, "É"), (10, "é")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.n_bytes in (0, 2)) == [(1, 2, 2, False), (2, 2, 2, True), (9, 9, 1, True), (10, 10, 1, True)]
    same = [r for r in got if r.text_sha256 == hashlib.sha256(b"ab c").hexdigest()]
    assert len(same) == 3 and sum(r.kept for r in same) == 1 and {(r.keep_id, r.group_size) for r in same} == {(3, 3)}
    assert exact_dedup.streaming_dedup(texts(spark, [])).count() == 0


def test_state_goes_on(spark, tmp_path):
    """Three calls with one state end with what one call over all rows says."""
    parts = [[(1, "a"), (2, "b"), (3, "B")], [], [(7, "A"), (0, "b"), (9, "c")], [(4, "a"), (None, "c"), (8, None)]]
    state = f"file://{tmp_path}/state"
    for rows in parts:
        last = exact_dedup.streaming_dedup(texts(spark, rows), state_dir=state).collect()
        assert len(last) == len(rows)
    whole = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.streaming_dedup(texts(spark, sum(parts, []))).collect()}
    assert {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in last} == {k: whole[k] for k in ((r.doc_id, r.text_sha256) for r in last)}


# --- 6 ---------------------------------------------------------------------------------------------------------


def similar(rows, width, percent):
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    at = {k: k for k in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {(k, len(s), root(k)) for k, s in sets.items()}


def near_texts(seed, n):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    base = [[rng.choice(pool) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    shared = [rng.choice(pool) for _ in range(30)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        out.append((k, " ".join((shared if rng.random() < 0.3 else []) + w)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_similar_documents(spark, width, percent):
    rows = near_texts(width, 160)
    got = ngram_join.similar_documents(texts(spark, rows), width=width, percent=percent)
    assert {tuple(r) for r in got.collect()} == similar(rows, width, percent)


def test_similar_documents_of_odd_rows(spark):
    got = ngram_join.similar_documents(texts(spark, ODD)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == sorted([(1, 1), (2, 2), (3, 3), (3, 3), (0, 0), (5, 3), (6, 6), (7, 7), (8, 8)])
    assert ngram_join.similar_documents(texts(spark, [])).count() == 0
    a, b = "a b c d e f g", "h i j k l m n"
    got = ngram_join.similar_documents(texts(spark, [(1, a), (3, b), (5, a), (5, b), (5, b)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 3), (5, 1), (5, 3), (5, 3)]


@pytest.mark.parametrize("small", [False, True])
def test_similar_documents_by_trees_alone(spark, monkeypatch, small):
    """Without stars, and with trees, look-ahead and rounds so small that each is exceeded."""
    monkeypatch.setattr(ngram_join, "STARS", 0)
    if small:
        for name, value in (("TREE", 4), ("LOOK", 2), ("FIRST_ROUND", 1), ("CELLS", 50), ("FOREST", 10)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = near_texts(31, 120)
    got = ngram_join.similar_documents(texts(spark, rows), width=3, percent=70)
    assert {tuple(r) for r in got.collect()} == similar(rows, 3, 70)


def shuffled_rows(spark):
    """Rows that the session's stages have written to exchanges so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_prefixes_cross_one_exchange(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(302))) for i in range(200)]
    rows += [(1000 + i, f"own{i} " + " ".join(f"w{i}x{k}" for k in range(302))) for i in range(5)]
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on tables too large to send whole
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(texts(spark, rows), width=3, percent=80).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i for i in range(200)} | {1000 + i: i for i in range(5)}
    assert shuffled_rows(spark) - before < 1.5 * 205 * 61  # 61 n-grams of 300 are the prefix


def test_shared_postings(spark):
    late = ngram_join.LATE
    sets = {7: [3, 5, 9, late + 1, late + 4], 8: [5, 9, late + 4], 9: [9, 11], 10: [late + 2]}
    ones = spark.createDataFrame([(k, len(g), g) for k, g in sets.items()], "rep long, n int, prefix array<long>")
    got = sorted((r.rep, r.pos, r.gram, r.df) for r in ngram_join.shared_postings(ones).collect())
    assert got == [(7, 1, 5, 2), (7, 2, 9, 3), (7, 4, late + 4, 2), (8, 0, 5, 2), (8, 1, 9, 3), (8, 2, late + 4, 2), (9, 0, 9, 3)]


def test_tree_candidates():
    """Of sets that share their first n-gram, every similar pair is a candidate, once, whatever the cut of the path."""
    rng = random.Random(5)
    for percent, look in ((50, 100), (70, 100), (80, 3), (85, 100)):
        base = [rng.sample(range(10, 200), rng.randint(5, 40)) for _ in range(6)]
        sets = []
        for i in range(120):
            s = set(rng.choice(base)) | {1}
            for _ in range(rng.randint(0, 6)):
                s ^= {rng.randrange(10, 200)}
            sets.append(sorted(s))
        p = [len(s) - ngram_join.least_overlap(len(s), percent) + 1 for s in sets]
        after = [s[1:k] for s, k in zip(sets, p, strict=True)]
        cols = [[0] * 120, [0] * 120, list(range(120)), [len(s) for s in sets], list(range(120)), [0] * 120, [s[k - 1] for s, k in zip(sets, p, strict=True)], [x[:look] for x in after], [list(range(1, len(x[:look]) + 1)) for x in after], [max(0, len(x) - look) for x in after], [0] * 120, list(range(120)), [1] * 120]
        q, m, more = ngram_join.tree_pairs(cols, percent, 0, 1000)
        pairs = [tuple(sorted(x)) for x in zip(q.tolist(), m.tolist(), strict=True)]
        want = {(i, j) for j in range(120) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))}
        assert want and want <= set(pairs) and len(pairs) == len(set(pairs)) and not len(more)
        parts = [ngram_join.tree_pairs(cols, percent, k, 7) for k in range(0, 140, 7)]
        assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(x for a, b, _ in parts for x in zip(a.tolist(), b.tolist(), strict=True)) and len(parts[0][2])


def test_prefix_tree():
    rng = random.Random(8)
    sets = [(i, sorted(rng.sample(range(60), rng.randint(1, 40)))) for i in range(80)]
    raw = lambda s: np.array(s, ">u8").tobytes()
    tree = ngram_join.PrefixTree([(i, raw(s)) for i, s in sets])
    for percent in (10, 50, 85):
        for _, q in sets[:20]:
            assert set(tree.similar(raw(q), percent)) == {i for i, s in sets if 100 * len(set(s) & set(q)) >= percent * len(set(s) | set(q))}


# --- 7 ---------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights, share, passes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > passes * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = passes * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_fair_queue(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "B", "z", None, "é"])) for i in range(600)]
    rows += [(1000 + i, "only few", "tiny") for i in range(3)] + [(5, None, "a"), (None, "x y", "a"), (7, "dup", "b"), (7, "dup", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.fair_queue(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = water_fill(sizes, (3, 1, 2), 1.5, 2)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 30
    again = mixing.fair_queue(df.repartition(5, F.rand(3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.fair_queue(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.fair_queue(df.withColumn("text", F.lit(""))).collect()} == {0}


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(60):
        t = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randint(0, 200)))
        got = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), 256).tolist()
        assert got == sorted(range(len(t)), key=lambda i: t[i:])


def cut(rows, length):
    first, out = {}, []
    for k, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], k) < k:
                gone[s : s + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((k, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_remove_repeats(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 120))) for _ in range(12)] + ["z" * 130, "xy" * 70]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(0, 5)))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)] + [(400, None), (401, ""), (402, "".join(parts) * 3)]
    got = suffix_dedup.remove_repeats(texts(spark, rows), length=50)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == cut(rows, 50)
    for r in got.where("kept IS NOT NULL").collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s["to"] - s["from"] for s in r.spans) == r.n_removed


def test_remove_repeats_in_small_blocks(monkeypatch):
    """Long rows are cut into pieces; every window is in just one."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    raw = np.frombuffer(bytes(random.Random(1).choices(range(97, 101), k=1000)), np.uint8)
    offsets = np.array([0, 10, 500, 560, 1000])
    seen = sorted(int(s) + a for _, a, starts, _ in suffix_dedup.block_windows(raw, offsets, 50) for s in starts)
    assert seen == [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 49)]


def test_remove_repeats_of_odd_rows(spark):
    a = "abcdefghij" * 6
    rows = [(1, None), (2, ""), (3, a), (3, a + "z"), (None, a), (5, a), (6, "q" + a[:50] + "é")]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(texts(spark, rows)).collect()}
    assert got == {(1, 0): (0, 0), (2, 0): (0, 0), (3, 60): (0, 0), (3, 61): (0, 0), (None, 60): (0, 0), (5, 60): (60, 1), (6, 53): (50, 1)}
    assert suffix_dedup.remove_repeats(texts(spark, [])).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(900):
        v = centres[i % 40] + rng.standard_normal(16) * (0.05 if i % 3 else 1.0)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 40 % 3)))
    rows += [(2000 + i, rows[1][1], rows[1][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"u": F.lit(1), "sim": F.lit(0)})
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    m = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = (m @ m.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    n = linked.sum(axis=1)
    have = np.array([got[i].n_links for i in ids.tolist()])
    assert (have <= n).all() and have.sum() >= 0.97 * n.sum()
    root = ids[embedding_dedup._roots(linked)]
    assert np.mean([got[i].component_id == c for i, c in zip(ids.tolist(), root.tolist(), strict=True)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {k for k, v in got.items() if v[0] == 3} == {3, 4, 9, 10} and got[4] == (3, 3, False) and got[3] == (3, 3, True)
    assert all(got[k] == (0, k, True) for k in (1, 2, 5, 6, 7, 8, 11, 12, 13)) and got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_beside_a_large_group(spark, monkeypatch):
    """Small blocks give a small table the bits of a large one; a third of the rows is one group of near copies."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    hot = unit(rng.standard_normal(64)[None, :] / 8 + rng.standard_normal((1000, 64)) * 0.02)
    a, b = unit(rng.standard_normal((300, 64))), rng.standard_normal((300, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.935, 0.94, (300, 1))
    m = np.concatenate([hot, unit(rng.standard_normal((1400, 64))), a, cos * a + np.sqrt(1 - cos**2) * b])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert np.mean([got[2400 + i] == got[2700 + i] == (1, 2400 + i) for i in range(300)]) >= 0.97
    assert np.mean([got[i][1] == 0 for i in range(1000)]) >= 0.97


def test_audit_counts_vectors_alike(spark, monkeypatch):
    rows = [Row(label=1, true=900, found=900)] * 90 + [Row(label=1, true=1, found=0)] * 10 + [Row(label=2, true=0, found=0)]
    assert embedding_dedup.judge(rows) == {"label 1": (100, 0.9), "256 links or more": (90, 1.0), "1 links or more": (10, 0.0)}
    assert [embedding_dedup.tables_for(n, 0.93) for n in (0, 5, 10, 20)] == [4, 7, 15, 57]
    monkeypatch.setattr(embedding_dedup, "RETRIES", 0)
    monkeypatch.setattr(embedding_dedup, "link_counts", lambda *_: spark.createDataFrame([], "u long, n long"))
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="misses links"):
        embedding_dedup.near_duplicates(df)


# --- 10 --------------------------------------------------------------------------------------------------------


def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    path = tokenizer_files.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*ODD, (20, " "), (21, "  a  b\n\tc▁d é 12 漢字𓀀 <s> </s> «x»."), (22, "a" * 200), (23, "the " * 3 + "x" * 70 + " 日本語" * 30), (24, "supercalifragilistic aaaaaaaa mississippi ½²"), (25, "نص عربي वाक्य")]
    docs = texts(spark, rows).select("doc_id", "text").unionByName(documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = pieces.encode_documents(docs, path).collect()
    want = sorted(np.array(lib.encode(t or ""), "<u4").tobytes() for _, t in docs.collect())
    assert sorted(bytes(r.ids) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) // 4 for r in got)
    assert pieces.encode_documents(texts(spark, []), path).count() == 0
    table = pieces.pieces(path)
    for w in ("abracadabra", "aaaaaaa", " internationalization", "x" * 90):
        assert table.encode_long(w) == lib.encode(w[1:] if w[0] == " " else "\n" + w)[0 if w[0] == " " else 2 :]
    some = spark.createDataFrame([(1, lib.encode("hello  wörld 漢字𓀀 ")), (2, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in pieces.decode_ids(some, "k", "ids", table).collect()} == {1: "hello  wörld 漢字𓀀 ", 2: ""}


def test_pieces_of_repeated_rows(spark, monkeypatch):
    import sentencepiece

    path = tokenizer_files.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    run = "".join(random.Random(3).choice("bcdfghjklmnpqrstvwxz") for _ in range(100))
    rows = [(1, f"so {run} goes"), (2, "the common text of some common words"), (2, "another text"), (None, run), (3, run), (None, None), (4, "")]
    rows = rows * 2 + [(k, t) for k, t in documents(spark).select("doc_id", "text").collect()] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit("x"), "word": F.lit(1), "_w": F.lit(2), "path": F.col("text")})
    for chunk in (pieces.CHUNK, 1000):  # one list for all, or very many
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        got = pieces.encode_documents(df.repartition(3), path, carry=("place", "path")).collect()
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(k), np.array(lib.encode(t or ""), "<u4").tobytes()) for k, t in rows)
        assert all(r.round_trip and r.n_pieces == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) and r.place == "x" for r in got)
        assert all(r.decoded_crc32 == zlib.crc32((r.path or "").encode()) for r in got)


def test_merges_that_wait(spark):
    """Random tables of merges: edges whose parts are put together only by worse merges are tried again."""
    rng = random.Random(11)
    for seed in range(4):
        names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(60)})
        rng.shuffle(names)
        scores = [-(i // (1 + seed)) for i in range(len(names))]  # with ties among pieces
        text = {p: (i, float(s)) for i, (p, s) in enumerate(zip(names, scores))} | {c: (100 + i, -1000.0) for i, c in enumerate("abc")}
        toy = pieces.Pieces(pieces.BPE, text, 200, None, [b""] * 201)
        some = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"zaz"}
        got = pieces.encode_words(spark.createDataFrame([(w,) for w in some], "word string"), toy).collect()
        assert len(got) == len(some)
        for r in got:
            assert toy.lookup[np.array(r.path)].tolist() == toy._merges(r.word), r.word


def test_models_that_are_refused(tmp_path):
    path = tokenizer_files.path("piece_bpe_32k.model")
    raw = open(path, "rb").read()
    head, rules = raw[:-20], raw[-20:]  # the normaliser's part is the last
    assert b"identity" in rules
    for other in (rules.replace(b"identity", b"nmt_nfkc"), rules.replace(b"\x18\x01 \x00", b"\x18\x00 \x00")):
        (tmp_path / "m.model").write_bytes(head + other)
        with pytest.raises(ValueError, match="normaliser"):
            pieces.Pieces.load(str(tmp_path / "m.model"))


def test_windows_of_a_long_text(monkeypatch):
    table = pieces.pieces(tokenizer_files.path("piece_bpe_32k.model"))
    text = "the  quick brown fox 12, " * 40 + "é漢 x" * 30
    whole = [w for s in table.segments(text) for w in s]
    monkeypatch.setattr(pieces, "WINDOW", 50)
    parts = list(table.windows(" " + text))
    assert len(parts) > 10 and "".join(parts) == " " + text
    assert "".join(w for s in table.segments(text) for w in s) == "".join(whole)


def test_viterbi_on_a_toy_unigram_table(spark):
    rng = random.Random(7)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "abca", "cc"]
    scores = {p: (i + 1, round(-rng.random() * 5, 3)) for i, p in enumerate(names)}
    toy = pieces.Pieces(pieces.UNIGRAM, scores, 0, None, [b"?"] + [p.encode() for p in names])
    some = ["".join(rng.choice("abcz") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    floor = min(s for _, s in toy.text.values()) - 10

    def best(w):
        if not w:
            return 0.0, []
        out = None
        for k in range(1, min(4, len(w)) + 1):
            p = w[:k]
            if p in toy.text or k == 1:
                i, s = toy.text.get(p, (0, floor))
                rest = best(w[k:])
                if out is None or s + rest[0] > out[0]:
                    out = (s + rest[0], [i, *rest[1]])
        return out

    got = {r.word: toy.lookup[np.array(r.path)].tolist() for r in pieces.encode_words(spark.createDataFrame([(w,) for w in set(some)], "word string"), toy).collect()}
    score = lambda ids: sum(floor if i == 0 else toy.text[names[i - 1]][1] for i in ids)
    for w in some:
        assert abs(score(got[w]) - best(w)[0]) < 1e-9 and abs(score(toy.encode_long(w)) - best(w)[0]) < 1e-9
