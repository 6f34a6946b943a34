"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, exact_dedup, hard_negatives, language_id, line_dedup, minhash_dedup, mixing, quality_classifier, quality_rules, sentencepiece_codec, sharding, token_packing, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_language_id": language_id.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_token_packing": token_packing.op6_token_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_bpe": bpe_codec.op12_bpe,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
