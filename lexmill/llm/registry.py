"""The queries of this subpackage and the SQL that states the same results where SQL can."""

from __future__ import annotations

from lexmill.llm import decontaminate, exact_dedup, html_extract, licences, line_dedup, packing, quality, simhash, surrogates, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_html_extraction": html_extract.query,
    "op3_decontamination": decontaminate.query,
    "op4_quality_classifier": quality.query,
    "op5_token_counts": token_counts.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_licence_scan": licences.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_best_fit_packing": packing.query,
    "op10_surrogates": surrogates.query,
}

ORACLE_SQL = {
    "op3_decontamination": decontaminate.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
}
