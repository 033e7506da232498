"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.bytestext import row_blocks, text_bytes
from kinfold.llm.scratch import bounded_batches, lean

#: Components of a hypervector.
DIM = 1024
#: Letters of one n-gram.
GRAM = 3
#: Symbols: 0 is the gap between words, letters below U+0180 have their own, all others share the rest by code point.
OWN = 0x180
SYMBOLS = 512
#: Most documents per language that profiles are fitted on (a bounded sample, chosen by hash).
FIT_DOCS = 1500
UNKNOWN = "und"
BLOCK = 1 << 19


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point (0 for anything but a letter; cases fold together), and the letters' random vectors."""
    symbol = np.zeros(0x110000, np.int16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            k = ord(low[0])
            symbol[c] = k if k < OWN else OWN + k * 2654435761 % (1 << 32) % (SYMBOLS - OWN)
    vectors = np.where(np.random.default_rng(20240607).integers(0, 2, (SYMBOLS, DIM)), 1, -1).astype(np.int8)
    return symbol, vectors


_made: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    if not _made:
        _made.append(_tables())
    return _made[0]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bind: the vector of an n-gram is the product of its letters' vectors, each permuted (rolled) by its place."""
    _, vectors = tables()
    out = np.ones((len(codes), DIM), np.int8)
    for place in range(GRAM):
        out *= np.roll(vectors, place, axis=1)[codes // SYMBOLS ** (GRAM - 1 - place) % SYMBOLS]
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets in them."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[offsets]


def bundles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bundle: each row's sum of the vectors of its n-grams (float32), and its number of letters.

    n-grams run over the letters of a row with every run of other characters as one gap; distinct n-grams of the block
    are bound once and enter through a matrix product with their counts.
    """
    points, at = code_points(data, offsets)
    n = len(at) - 1
    sym = tables()[0][points].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(at))
    letters = np.bincount(row, sym > 0, n)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (row[1:] != row[:-1])
    sym, row = sym[keep], row[keep]
    if len(sym) < GRAM:
        return np.zeros((n, DIM), np.float32), letters
    size = len(sym) - GRAM + 1
    code = np.zeros(size, np.int64)
    for k in range(GRAM):
        code = code * SYMBOLS + sym[k : k + size]
    inside = row[:size] == row[GRAM - 1 :]
    code, row = code[inside], row[:size][inside]
    distinct, place = np.unique(code, return_inverse=True)
    out = np.zeros((n, DIM), np.float32)
    for a in range(0, n, 128):
        lo, hi = np.searchsorted(row, [a, a + 128])
        if hi > lo:
            used, local = np.unique(place[lo:hi], return_inverse=True)
            counts = np.bincount((row[lo:hi] - a) * len(used) + local, minlength=min(128, n - a) * len(used)).astype(np.float32).reshape(-1, len(used))
            for b in range(0, len(used), 8192):
                out[a : a + 128] += counts[:, b : b + 8192] @ gram_vectors(distinct[used[b : b + 8192]]).astype(np.float32)
    return out, letters


def _row_bundles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bundles of blocks of rows; a very long row is taken in pieces whose n-grams overlap at the cuts."""
    data, offsets = text_bytes(column)
    for a, b in row_blocks(offsets, BLOCK):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 4 * BLOCK:
            yield bundles(data[lo:hi], offsets[a : b + 1] - lo)
            continue
        total, letters = np.zeros((1, DIM), np.float32), np.zeros(1)
        while lo < hi:
            to = min(hi, lo + BLOCK)
            while to < hi and data[to] & 0xC0 == 0x80:
                to -= 1
            back = lo
            for _ in range((GRAM - 1) if lo > offsets[a] else 0):
                back -= 1
                while data[back] & 0xC0 == 0x80:
                    back -= 1
            v, k = bundles(data[back:to], np.array([0, to - back]))
            total += v
            letters += k
            lo = to
        yield total, letters


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        lang, at = b.column(1).to_pylist(), 0
        for v, letters in _row_bundles(b.column(0)):
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            for i in np.flatnonzero(letters).tolist():
                sums[lang[at + i]] = sums.get(lang[at + i], 0) + v[i].astype(np.float64)
            at += len(v)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "profile": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})


class Profiles:
    """A unit vector per language, in the order of the languages' names."""

    def __init__(self, sums: dict[str, np.ndarray]) -> None:
        self.langs = sorted(sums)
        m = np.array([sums[k] for k in self.langs], np.float64).reshape(-1, DIM)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        self.matrix = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).astype(np.float32)


def fit(docs: DataFrame, *, per_language: int = FIT_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the non-null languages of ``docs`` from at most ``per_language`` documents of each, chosen by a
    hash of key and text.  Languages are few, so their counts and sums (``DIM`` numbers each) come to the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    labelled = docs.where(F.col(lang).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 100) / F.col("_n"))  # leaves few rows to rank
    pick = F.xxhash64(F.lit(11), F.col(key), F.col(text))
    chance = F.shiftrightunsigned(pick, 11) / F.lit(float(1 << 53))
    some = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), pick.alias("_h"), chance.alias("_c")).join(F.broadcast(counts), F.col("lang") == F.col("_l"))
    some = some.where(F.col("_c") < share)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= per_language)
    parts = ranked.select("text", "lang").repartition(12).mapInArrow(lean(_fit), "lang string, profile array<double>")
    sums: dict[str, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.lang, r.profile)):
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.profile)
    return Profiles(sums)


def classify(texts: pa.Array, profiles: Profiles) -> tuple[list[str], np.ndarray]:
    langs: list[str] = []
    scores: list[np.ndarray] = []
    for v, letters in _row_bundles(texts):
        norm = np.linalg.norm(v, axis=1)
        if not profiles.langs:
            langs += [UNKNOWN] * len(v)
            scores.append(np.zeros(len(v)))
            continue
        cosine = np.divide(v @ profiles.matrix.T, norm[:, None], out=np.zeros((len(v), len(profiles.langs)), np.float32), where=norm[:, None] > 0)
        best = cosine.argmax(axis=1)
        known = letters > 0
        langs += [profiles.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
        scores.append(np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def _predict(profiles: Profiles, column: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = classify(b.column(column), profiles)
            kept = [b.column(i) for i in range(b.num_columns) if i != column]
            names = [b.schema.field(i).name for i in range(b.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score``, from the whole text alone.

    ``score`` is the cosine with the best profile (0 where it is below).  Ties go to the first name.  Null texts and
    texts without a letter are ``und`` with score 0; so is everything when there are no profiles.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*carry, F.col(text).alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(_predict(profiles, len(carry))), f"{ddl}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = fit(docs.where(~held_out()))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
