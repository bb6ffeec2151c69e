"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from stallwise.llm import chat_format, decontaminate, html_extract, license_scan, line_dedup, lm_scoring, near_dedup, packing, quality, source_divergence, suffix_dedup, toxicity, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_packing": packing.op7_packing,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op13_source_divergence": source_divergence.OP13_SQL,
}
