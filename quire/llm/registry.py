"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quire.llm import chat, decontaminate, embedding_dedup, html, jaccard_join, licenses, oracles, packing, quality, sharding, tokencount

QUERIES = {
    "op1_bm25_decontamination": decontaminate.op1_bm25_decontamination,
    "op2_slot_sharding": sharding.op2_slot_sharding,
    "op3_hilbert_packing": packing.op3_hilbert_packing,
    "op4_site_template_text": html.op4_site_template_text,
    "op5_additive_quality": quality.op5_additive_quality,
    "op6_longest_match_counts": tokencount.op6_longest_match_counts,
    "op7_diagonal_licenses": licenses.op7_diagonal_licenses,
    "op8_count_tree_jaccard": jaccard_join.op8_count_tree_jaccard,
    "op9_grammar_chat": chat.op9_grammar_chat,
    "op10_itq_near_dedup": embedding_dedup.op10_itq_near_dedup,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
