"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, decontamination, fingerprints, hard_negatives, line_dedup, near_dedup, ngram_join, packing, pii, sharding, token_counts, toxicity

QUERIES = {
    "op2_pii_surrogates": pii.op2_pii_surrogates,
    "op1_toxicity": toxicity.op1_toxicity,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_ngram_jaccard_join": ngram_join.op11_ngram_jaccard_join,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op8_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
