"""Queries of the training-data operators, with SQL where SQL can give their rows."""

from __future__ import annotations

from skipweave.llm import byte_bpe, elkan, exact_dedup, language, license_scan, lm_score, packing, pieces, quality_rules, resample, simhash, token_output, url_filter


def queries():
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_language_id": language.op3_language_id,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_lm_scores": lm_score.op5_lm_scores,
        "op6_token_output": token_output.op6_token_output,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_simhash_dedup": simhash.op9_simhash_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_importance_resampling": resample.op11_importance_resampling,
        "op12_centroid_clustering": elkan.op12_centroid_clustering,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql():
    return {"op8_url_filter": url_filter.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_importance_resampling": resample.ORACLE}
