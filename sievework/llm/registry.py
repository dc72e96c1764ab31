"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import conversation_repair, gru_lm, host_rules, jaccard_join, license_scan, metric_join, mixing, packing, quality_cnn, string_kernel, suffix_dedup, token_files, vector_codes


def queries() -> dict:
    """Name to query."""
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_embedding_links": metric_join.op2_embedding_links,
        "op3_token_counts": token_files.op3_token_counts,
        "op4_packing": packing.op4_packing,
        "op5_licenses": license_scan.op5_licenses,
        "op6_host_rules": host_rules.op6_host_rules,
        "op7_language_model": gru_lm.op7_language_model,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_jaccard": jaccard_join.op9_jaccard,
        "op10_quality": quality_cnn.op10_quality,
        "op11_language_id": string_kernel.op11_language_id,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {"op1_suffix_dedup": suffix_dedup.OP1_SQL, "op2_embedding_links": metric_join.OP2_SQL, "op6_host_rules": host_rules.OP6_SQL, "op8_source_mix": mixing.OP8_SQL, "op9_jaccard": jaccard_join.OP9_SQL, "op12_conversation_repair": conversation_repair.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
