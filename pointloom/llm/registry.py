"""Queries of this subpackage, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from pointloom.llm import chat, decontaminate, jaccard, packing, quality, scoring, substrings, toxicity, urls, vectors

QUERIES = {
    "op1_sum_of_squares_packing": packing.query,
    "op2_hidden_markov_scores": scoring.query,
    "op3_winnowing_decontamination": decontaminate.query,
    "op4_toxicity_trees": toxicity.query,
    "op8_subspace_pigeonhole": vectors.query,
    "op9_kneser_ney_quality": quality.query,
    "op10_bayesian_jaccard": jaccard.query,
    "op5_suffix_dedup": substrings.query,
    "op6_chat_snapshots": chat.query,
    "op7_url_rules": urls.query,
}
ORACLES = {
    "op3_winnowing_decontamination": decontaminate.ORACLE,
    "op5_suffix_dedup": substrings.ORACLE,
    "op6_chat_snapshots": chat.ORACLE,
    "op7_url_rules": urls.ORACLE,
    "op8_subspace_pigeonhole": vectors.ORACLE,
    "op10_bayesian_jaccard": jaccard.ORACLE,
}
