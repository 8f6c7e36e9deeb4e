"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import align, edit_counts, exact_dedup, html_text, langid, mixing, packing, periodic, quality, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_language_id": langid.op8_language_id,
    "op9_token_counts": edit_counts.op9_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_token_alignment": align.op12_token_alignment,
    "op13_legacy_archives": warc.op13_legacy_archives,
}

ORACLE_SQL = {
    "op6_url_filters": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_legacy_archives": warc.ORACLE,
}
