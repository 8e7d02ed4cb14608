"""Queries of this subpackage and, where SQL can say the same, their DuckDB counterparts."""

from __future__ import annotations

from typeloom.llm import decontaminate, language_id, line_dedup, near_dedup, packing, pii, quality_rules, sharding, token_store, url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_quality_cascade": quality_rules.op2_quality_cascade,
        "op3_language_id": language_id.op3_language_id,
        "op4_bagminhash": near_dedup.op4_bagminhash,
        "op5_blocked_bloom": url_filter.op5_blocked_bloom,
        "op5_blocked_bloom_all_hosts": url_filter.op5_blocked_bloom_all_hosts,
        "op6_bounded_ring": sharding.op6_bounded_ring,
        "op7_token_store": token_store.op7_token_store,
        "op8_fm_index_decontamination": decontaminate.op8_fm_index_decontamination,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_cascade": quality_rules.oracle(),
        "op5_blocked_bloom": url_filter.oracle(),
        "op5_blocked_bloom_all_hosts": url_filter.oracle_all_hosts(),
        "op8_fm_index_decontamination": decontaminate.oracle(),
    }
