"""Queries of this subpackage, and the SQL that states their results."""

from __future__ import annotations

from . import chat, decontam, mixing, neardup, pii, search, substring, suffixes, tokens, toxicity

QUERIES = {
    "op1_chat_collapse": chat.op1_chat_collapse,
    "op2_token_output": tokens.op2_token_output,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_pseudonyms": pii.op6_pseudonyms,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_top_k": search.op8_top_k,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}

ORACLE_SQL = {
    "op1_chat_collapse": chat.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
}
