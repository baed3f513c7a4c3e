"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from noticeloom.llm import best_fit, chat_template, filter_audit, jaccard_join, license_scan, mixing, packing, passage_chains, pii, quality_pu, source_divergence, topk_search, vector_dedup

QUERIES = {
    "op5_passage_chains": passage_chains.op5_passage_chains,
    "op3_vector_dedup": vector_dedup.op3_vector_dedup,
    "op8_topk_search": topk_search.op8_topk_search,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op1_quality_pu": quality_pu.op1_quality_pu,
    "op2_mixing": mixing.op2_mixing,
    "op4_packing": packing.op4_packing,
    "op6_chat_template": chat_template.op6_chat_template,
    "op9_pii": pii.op9_pii,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_best_fit": best_fit.op12_best_fit,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

SQL = {
    "op3_vector_dedup": vector_dedup.OP3_SQL,
    "op8_topk_search": topk_search.OP8_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op6_chat_template": chat_template.OP6_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_source_divergence": source_divergence.OP13_SQL,
}
