"""The subpackage's queries: name -> function of (spark, sf_dir), and DuckDB SQL where it can express them."""

from __future__ import annotations

from flowgraph.llm import binary_records, decontaminate, language_id, line_quality, ngram_join, packing, pii_crf, sharding, suffix_dedup, token_counts

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_token_counts": token_counts.query,
    "op3_ngram_join": ngram_join.query,
    "op4_binary_records": binary_records.query,
    "op5_language_id": language_id.query,
    "op6_packing": packing.query,
    "op7_ring_sharding": sharding.query,
    "op8_decontamination": decontaminate.query,
    "op9_line_quality": line_quality.query,
    "op10_pii_crf": pii_crf.query,
}

ORACLE_SQL: dict[str, str] = {"op9_line_quality": line_quality.ORACLE_SQL}
