"""Registered queries of this folder and the SQL that states the same results."""

from __future__ import annotations

from . import (
    bpe,
    chat,
    exact_dedup,
    fm_index,
    lm_scoring,
    minhash,
    mixing,
    quality,
    ranked_search,
    repair,
    sharding,
    suffix_dedup,
    token_files,
)

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_substring_dedup": fm_index.query,
    "op3_sharding": sharding.query,
    "op4_quality_rules": quality.query,
    "op5_chat_formatting": chat.query,
    "op6_minhash_near_dedup": minhash.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_mixing": mixing.query,
    "op9_byte_bpe": bpe.query,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_conversation_repair": repair.query,
    "op12_lm_scoring": lm_scoring.query,
    "op13_ranked_search": ranked_search.query,
}

SQL = {
    "op2_substring_dedup": fm_index.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_chat_formatting": chat.SQL,
    "op6_minhash_near_dedup": minhash.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op11_conversation_repair": repair.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
