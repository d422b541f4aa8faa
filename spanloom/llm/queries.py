"""Queries over the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from spanloom.llm import centroids, class_lm, codebooks, contamination, licenses, packing, paragraphs, quality, sharding, simhash, suffixes, token_files, topk

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": token_files.op5_token_counts,
    "op6_decontamination": contamination.op6_decontamination,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_substrings": paragraphs.op9_substrings,
    "op10_topk_search": topk.op10_topk_search,
    "op11_centroids": centroids.op11_centroids,
    "op12_class_lm": class_lm.op12_class_lm,
    "op13_vector_codes": codebooks.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_licenses": licenses.OP1_SQL,
    "op10_topk_search": topk.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op13_vector_codes": codebooks.OP13_SQL,
}
