"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from cartoflux.llm import ann, class_lm, divergence, exact_topk, jaccard_join, media, mixing, periodic_runs, quality, suffix_dedup, token_counts, unigram, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_unigram_codec": unigram.op2_unigram_codec,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_quality": quality.op6_quality,
    "op7_nearest": ann.op7_nearest,
    "op8_media_columns": media.op8_media_columns,
    "op9_class_lm": class_lm.op9_class_lm,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_exact_topk": exact_topk.op11_exact_topk,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op5_url_filters": url_filter.ORACLE_SQL,
    "op11_exact_topk": exact_topk.ORACLE_SQL,
    "op13_divergence": divergence.ORACLE_SQL,
}
