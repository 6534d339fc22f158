"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, language, minhash, negatives, packing, personal, quality, repeats, rules, shards, similar, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
        "op2_language_id": language.op2_language_id,
        "op3_token_store": tokens.op3_token_store,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_ngram_jaccard_join": similar.op6_ngram_jaccard_join,
        "op7_two_pass_shuffle": shards.op7_two_pass_shuffle,
        "op8_distribution_divergence": rules.op8_distribution_divergence,
        "op9_personal_data": personal.op9_personal_data,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_benchmark_decontamination": decontaminate.ORACLE,
        "op12_minhash_near_dedup": minhash.ORACLE,
        "op13_hard_negatives": negatives.ORACLE,
    }
