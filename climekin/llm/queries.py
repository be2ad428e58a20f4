"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from climekin.llm import exact_dedup, html_extract, mixing, near_dedup, packing, quality, substring_dedup, token_counts, token_store, topk_search

QUERIES = {
    "op1_token_ids": token_store.op1_token_ids,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op8_quality": quality.op8_quality,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_html_text": html_extract.op5_html_text,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op6_packing": packing.op6_packing,
}

ORACLE_SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_topk_search": topk_search.OP4_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
}
