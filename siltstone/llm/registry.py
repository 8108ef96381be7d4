"""Queries of this package by name, and their SQL where SQL can express them."""

from . import chat, exact_dedup, language, mixing, near_dedup, ngram, pieces, quality, sharding, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_lm_score": ngram.op4_lm_score,
    "op5_language_id": language.op5_language_id,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_shard": sharding.op10_shard,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
