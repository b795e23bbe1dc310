"""The dealt operators as named queries, with SQL where SQL can say the same."""

from __future__ import annotations

from . import (
    bpe,
    embedding_dedup,
    hard_negatives,
    line_dedup,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    secret_scan,
    sharding,
    token_store,
    url_filter,
    vector_codes,
)


def queries() -> dict:
    return {
        "op1_secret_scans": secret_scan.op1_query,
        "op2_minhash_near_dedup": near_dedup.op2_query,
        "op3_sharding": sharding.op3_query,
        "op4_quality_rules": quality_rules.op4_query,
        "op5_bpe": bpe.op5_query,
        "op6_url_filters": url_filter.op6_query,
        "op7_token_store": token_store.op7_query,
        "op8_mixing": mixing.op8_query,
        "op9_line_dedup": line_dedup.op9_query,
        "op10_embedding_near_dedup": embedding_dedup.op10_query,
        "op11_vector_codes": vector_codes.op11_query,
        "op12_hard_negatives": hard_negatives.op12_query,
        "op13_quality_classifier": quality_model.op13_query,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_secret_scans": secret_scan.op1_sql(),
        "op3_sharding": sharding.op3_sql(),
        "op4_quality_rules": quality_rules.op4_sql(),
        "op6_url_filters": url_filter.op6_sql(),
        "op8_mixing": mixing.op8_sql(),
        "op9_line_dedup": line_dedup.op9_sql(),
        "op11_vector_codes": vector_codes.op11_sql(),
        "op12_hard_negatives": hard_negatives.op12_sql(),
    }
