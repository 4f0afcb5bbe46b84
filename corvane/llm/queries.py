"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import chat, divergence, exact_dedup, flac, importance, lm, mixing, packing, pii, simhash, slack_packing, toxicity, url_filter

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_pii": pii.query,
    "op3_toxicity": toxicity.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_lm_score": lm.query,
    "op6_source_mixing": mixing.query,
    "op7_chat_format": chat.query,
    "op8_media_columns": flac.query,
    "op9_best_fit_packing": packing.query,
    "op10_url_filter": url_filter.query,
    "op11_source_divergence": divergence.query,
    "op12_slack_packing": slack_packing.query,
    "op13_importance_resampling": importance.query,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_source_mixing": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}
