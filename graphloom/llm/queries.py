"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, hard_negatives, language_id, license_scan, lm_score, mixing, quality, resample, sharding, simhash, suffix_dedup, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_warc": warc.op4_warc,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_bpe": bpe.op6_bpe,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_id": language_id.op10_language_id,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_sharding": sharding.op12_sharding,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op4_warc": warc.ORACLE,
    "op8_lm_score": lm_score.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
