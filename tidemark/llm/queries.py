"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, fingerprint, license_scan, line_dedup, lm_scoring, mixing, ngram_join, pii, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_pii": pii.op3_pii,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_document_fingerprints": fingerprint.op7_document_fingerprints,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_license_scans": license_scan.op9_license_scans,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_lm_scoring": lm_scoring.op11_lm_scoring,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
}

SQL: dict[str, str] = {
    "op8_url_filters": url_filter.OP8_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
}
