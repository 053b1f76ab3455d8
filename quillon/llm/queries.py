"""The queries and SQL of this package, by name."""

from __future__ import annotations

from . import centroids, conversation_repair, decontamination, embedding_dedup, language_id, mixing, ngram_join, pii, ppm_scoring, sharding, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_benchmark_decontamination": decontamination.op1,
    "op2_ngram_jaccard_join": ngram_join.op2,
    "op3_lm_scoring": ppm_scoring.op3,
    "op4_token_output": token_output.op4,
    "op5_embedding_near_dedup": embedding_dedup.op5,
    "op6_pii": pii.op6,
    "op7_sharding": sharding.op7,
    "op8_language_id": language_id.op8,
    "op9_mixing": mixing.op9,
    "op10_suffix_array_dedup": suffix_dedup.op10,
    "op11_centroid_clustering": centroids.op11,
    "op12_toxicity": toxicity.op12,
    "op13_conversation_repair": conversation_repair.op13,
}

SQL = {
    "op1_benchmark_decontamination": decontamination.OP1_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_centroid_clustering": centroids.OP11_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
