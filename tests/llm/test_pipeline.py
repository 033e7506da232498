"""The pipeline against brute force, stage by stage and as a whole."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_small import similar, water_fill, words

tokenizer_files = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_and_run(spark):
    import corpus_pipeline as C
    import sentencepiece

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages, before = dict(C.STAGES), rows_of(docs)
    assert list(stages) == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)

    kept = rows_of(stages["language ID"](spark, docs, DIR))
    assert sorted(kept) == sorted(r for r in before if any(c.isalpha() for c in r[1]))

    lower = lambda t: t.encode().lower()
    last = {}
    for r in kept:
        last[lower(r[1])] = max(last.get(lower(r[1]), r[0]), r[0])
    exact = rows_of(stages["exact dedup"](spark, frame(kept), DIR))
    assert sorted(exact) == sorted(r for r in kept if last[lower(r[1])] == r[0])

    group = {k: c for k, _, c in similar([r[:2] for r in exact], 5, 80)}
    near = rows_of(stages["n-gram Jaccard join"](spark, frame(exact), DIR))
    assert sorted(near) == sorted(r for r in exact if group[r[0]] == r[0])

    mixed = rows_of(stages["mixing sources to target weights"](spark, frame(near), DIR))
    times, sizes, taken = Counter(mixed), Counter(), Counter()
    assert set(times) <= set(near) and max(times.values()) <= 2
    for r in near:
        sizes[r[3]] += len(words(r[1]))
        taken[r[3]] += times[r] * len(words(r[1]))
    target, longest = water_fill(sizes, (3, 1, 2), 1.5, 2), max(len(words(r[1])) for r in near)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    got = C.run(spark, DIR).collect()
    assert Counter((r.doc_id, r.ids_crc32, r.source) for r in got) == Counter((r[0], zlib.crc32(np.array(lib.encode(r[1]), "<u4").tobytes()), r[3]) for r in mixed)
    assert all(r.round_trip for r in got)


def test_language_stage_judges_by_language(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rng = random.Random(4)
    junk = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60))
    unlike = [(10**6 + i, junk(("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцч", "漢字日本語中文学生先今年月水火木金土")[i % 3])) for i in range(60)]
    short = [(2 * 10**6 + i, t) for i, t in enumerate(["A.", "b", "Й", "ok", "12 x 34", "qzx"])]
    none = [(3 * 10**6 + i, t) for i, t in enumerate(["", None, "12 34.", "\n--"])]
    more = spark.createDataFrame([(k, t, None, "web", len(t or "")) for k, t in [*unlike, *short, *none]], docs.schema)
    kept = {r.doc_id for r in C.language(spark, docs.unionByName(more), DIR).where("doc_id >= 1000000").collect()}
    assert kept == {k for k, _ in short}
