"""A corpus pipeline: language, exact copies, near copies, mixture, tokens.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``; each stage's rows are written and read again before the next.
Each stage begins with the memory that the driver got for the one before given back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.exact_dedup import streaming_dedup
from kinfold.llm.language_id import UNKNOWN, fit, predict
from kinfold.llm.mixing import fair_queue
from kinfold.llm.ngram_join import similar_documents
from kinfold.llm.pieces import encode_documents
from kinfold.llm.scratch import materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Letters from which a text is judged by its language, and the least cosine with a profile that it then needs.  The cosine
#: of text unlike every profile is noise of about 1 / sqrt(1,024) a profile; this is five times that.
ENOUGH_LETTERS, LEAST_SCORE = 20, 0.16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language.  Rejected are texts without a letter, and texts of ``ENOUGH_LETTERS`` or more
    whose best score is below ``LEAST_SCORE``: letter junk and languages without a profile.  Texts with fewer letters are
    too short to judge and stay.  Profiles are fitted on the labelled documents of the input."""
    release(spark)
    profiles = fit(docs)
    scored = predict(docs, profiles, carry=COLUMNS)
    few = F.length(F.regexp_replace("text", r"\P{L}+", "")) < ENOUGH_LETTERS
    return scored.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | few)).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, so that rows without or with equal doc_ids are told apart."""
    return materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays; of rows that share that too, one."""
    release(spark)
    found = streaming_dedup(docs).where("kept").select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    rows = docs.select(*COLUMNS, sha.alias("sha"))
    stay = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["sha"] == found["sha"]), "left_semi")
    # rows that agree in doc_id and text are as good as each other
    return stay.dropDuplicates(["doc_id", "sha"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 on five-word shingles join, the document with the smallest doc_id stays."""
    release(spark)
    found = similar_documents(docs).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    release(spark)
    rows = _keyed(docs)
    times = fair_queue(rows, key="row", order=("doc_id", "text")).select(F.col("doc_id").alias("row"), "times").where("times > 0")
    mixed = rows.join(times, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return mixed.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip, ids, lang, source`` of every document of the mixture."""
    release(spark)
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("lang", "source"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: Language profiles, the mixture's hash order and pieces are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
