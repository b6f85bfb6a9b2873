"""Queries of this subpackage for ``__spark_entry__``: each reads its whole table."""

from __future__ import annotations

from . import byte_bpe, chat, exact_dedup, fingerprints, hard_negatives, jaccard_join, mixing, packing, quality, secret_scan, substring_dedup, token_counts, vector_codes

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_tool_calls": chat.op3_tool_calls,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_packing": packing.op6_packing,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_source_mix": mixing.op13_source_mix,
}

ORACLES = {
    "op1_jaccard_join": jaccard_join.ORACLE,
    "op3_tool_calls": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_source_mix": mixing.ORACLE,
}
