"""Registered queries of this subpackage: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from lexiscope.llm import conversations, decontaminate, html_text, jaccard_join, langid, license_scan, lz_fingerprint, packing, ranked_search, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_benchmark_decontamination": (decontaminate.op1_benchmark_decontamination, decontaminate.OP1_SQL),
    "op5_license_scan": (license_scan.op5_license_scan, None),
    "op6_substring_dedup": (substring_dedup.op6_substring_dedup, None),
    "op7_language_id": (langid.op7_language_id, None),
    "op2_toxicity": (toxicity.op2_toxicity, None),
    "op3_html_extraction": (html_text.op3_html_extraction, None),
    "op4_best_fit_packing": (packing.op4_best_fit_packing, None),
    "op8_token_counts": (token_counts.op8_token_counts, None),
    "op9_ngram_jaccard_join": (jaccard_join.op9_ngram_jaccard_join, None),
    "op10_document_fingerprints": (lz_fingerprint.op10_document_fingerprints, None),
    "op11_simhash_near_dedup": (simhash.op11_simhash_near_dedup, None),
    "op12_ranked_lexical_search": (ranked_search.op12_ranked_lexical_search, ranked_search.OP12_SQL),
    "op13_conversation_repair": (conversations.op13_conversation_repair, None),
}
