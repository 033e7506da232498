"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from kinfold.llm import embedding_dedup, exact_dedup, language_id, mixing, ngram_join, pieces, sharding, suffix_dedup, token_planes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_normaliser": warc.op1_warc_normaliser,
        "op2_token_planes": token_planes.op2_token_planes,
        "op3_jump_sharding": sharding.op3_jump_sharding,
        "op4_hyperdimensional_language": language_id.op4_hyperdimensional_language,
        "op5_streaming_dedup": exact_dedup.op5_streaming_dedup,
        "op6_prefix_tree_join": ngram_join.op6_prefix_tree_join,
        "op7_weighted_fair_queue": mixing.op7_weighted_fair_queue,
        "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
        "op9_nn_descent": embedding_dedup.op9_nn_descent,
        "op10_sentencepiece_lattice": pieces.op10_sentencepiece_lattice,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normaliser": warc.SQL,
        "op5_streaming_dedup": exact_dedup.SQL,
    } | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
