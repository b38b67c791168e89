"""The registered queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from plumbline.llm import (divergence, exact_dedup, exact_topk, html_text, language_id, mixing, near_dup, packing, quality_classifier,
                           quality_rules, url_filter, vector_codes, warc)

# Learned models, token ids and near-copy search over whole tables are beyond SQL; tests compare those with brute force.
QUERIES = {
    "op1_quality_rules": (quality_rules.op1, None),
    "op2_url_filters": (url_filter.op2, url_filter.SQL),
    "op3_html_extraction": (html_text.op3, None),
    "op4_best_fit_packing": (packing.op4, None),
    "op5_exact_dedup": (exact_dedup.op5, exact_dedup.SQL),
    "op6_ngram_jaccard_join": (near_dup.op6, None),
    "op7_warc_revisits": (warc.op7, warc.SQL),
    "op8_quality_classifier": (quality_classifier.op8, None),
    "op9_mixing_sources": (mixing.op9, None),
    "op10_language_id": (language_id.op10, None),
    "op11_vector_codes": (vector_codes.op11, vector_codes.SQL),
    "op12_exact_topk": (exact_topk.op12, exact_topk.SQL),
    "op13_source_divergence": (divergence.op13, divergence.SQL),
}
