"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from mensura.llm import ball_kmeans, lexical, licenses, maxscore, minhash, packing, pivots, ppm, quality_ranker, quality_rules, source_mix, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_ranker": quality_ranker.query,
    "op3_toxicity_mil": toxicity.query,
    "op4_source_mix": source_mix.query,
    "op5_maxscore_topk": maxscore.query,
    "op6_circulant_minhash": minhash.query,
    "op7_ppm_scores": ppm.query,
    "op8_license_scan": licenses.query,
    "op9_vector_packing": packing.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_ball_kmeans": ball_kmeans.query,
    "op12_pivot_permutation": pivots.query,
    "op13_quantised_index": lexical.query,
    "instruction_packing": packing.instruction_query,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle(),
    "op4_source_mix": source_mix.ORACLE,
    "op5_maxscore_topk": maxscore.ORACLE,
    "op6_circulant_minhash": minhash.ORACLE,
    "op11_ball_kmeans": ball_kmeans.oracle(),
    "op12_pivot_permutation": pivots.ORACLE,
    "op13_quantised_index": lexical.ORACLE,
}
