"""The queries of the dealt operators, and their SQL where there is one."""

from __future__ import annotations

from tablewright.llm import q1, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12, q13


def queries() -> dict:
    """opN_<name> by name."""
    return {
        "op1_best_fit_packing": q1.op1_best_fit_packing,
        "op2_sentencepiece": q2.op2_sentencepiece,
        "op3_chat_format": q3.op3_chat_format,
        "op4_embedding_dedup": q4.op4_embedding_dedup,
        "op5_top_k_search": q5.op5_top_k_search,
        "op6_license_scan": q6.op6_license_scan,
        "op7_html_text": q7.op7_html_text,
        "op8_suffix_dedup": q8.op8_suffix_dedup,
        "op9_simhash_dedup": q9.op9_simhash_dedup,
        "op10_toxicity": q10.op10_toxicity,
        "op11_centroid_clusters": q11.op11_centroid_clusters,
        "op12_conversation_repair": q12.op12_conversation_repair,
        "op13_secret_scan": q13.op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return {
        "op3_chat_format": q3.SQL,
        "op4_embedding_dedup": q4.SQL,
        "op5_top_k_search": q5.SQL,
        "op6_license_scan": q6.SQL,
        "op8_suffix_dedup": q8.SQL,
        "op11_centroid_clusters": q11.SQL,
        "op12_conversation_repair": q12.SQL,
        "op13_secret_scan": q13.SQL,
    }
