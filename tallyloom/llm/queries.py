"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from tallyloom.llm import op1_query, op2_query, op3_query, op4_query, op5_query, op6_query, op7_query, op8_query, op9_query, op10_query, op11_query, op12_query, op13_query

QUERIES = {
    "op1_source_mixing": op1_query.op1_source_mixing,
    "op2_url_filter": op2_query.op2_url_filter,
    "op3_embedding_dedup": op3_query.op3_embedding_dedup,
    "op4_chat_format": op4_query.op4_chat_format,
    "op5_order_minhash": op5_query.op5_order_minhash,
    "op6_token_counts": op6_query.op6_token_counts,
    "op7_best_fit_packing": op7_query.op7_best_fit_packing,
    "op8_exact_topk": op8_query.op8_exact_topk,
    "op9_toxicity": op9_query.op9_toxicity,
    "op10_quality_classifier": op10_query.op10_quality_classifier,
    "op11_prefix_trie": op11_query.op11_prefix_trie,
    "op12_language_id": op12_query.op12_language_id,
    "op13_importance_resampling": op13_query.op13_importance_resampling,
}
ORACLES = {
    "op1_source_mixing": op1_query.ORACLE,
    "op2_url_filter": op2_query.ORACLE,
    "op4_chat_format": op4_query.ORACLE,
    "op8_exact_topk": op8_query.ORACLE,
    "op11_prefix_trie": op11_query.ORACLE,
    "op13_importance_resampling": op13_query.ORACLE,
}
