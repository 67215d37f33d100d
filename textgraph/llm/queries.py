"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language_model, line_dedup, near_dedup, packing, pii, prefix_trie, quality_rules, sentencepiece_codec, sharding, token_store, toxicity, whitening
from .common import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_learned_decision_list": quality_rules.registered,
        "op2_proportional_interleaving": lambda s, d: sharding.query(s, documents(s, d)),
        "op3_lsh_forest_near_dedup": lambda s, d: near_dedup.query(s, documents(s, d)),
        "op4_gated_recurrent_lm": lambda s, d: language_model.query(s, documents(s, d)),
        "op5_sentencepiece_merge_rounds": lambda s, d: sentencepiece_codec.query(s, documents(s, d)),
        "op6_candidate_boosting_pii": lambda s, d: pii.query(s, documents(s, d)),
        "op7_positive_unlabelled_toxicity": toxicity.registered,
        "op8_line_dedup_runs": lambda s, d: line_dedup.query(s, documents(s, d)),
        "op9_addressable_token_files": lambda s, d: token_store.query(s, documents(s, d)),
        "op10_containment_search": lambda s, d: decontamination.query(s, documents(s, d), documents(s, d, "benchmark")),
        "op11_power_of_two_packing": lambda s, d: packing.query(s, documents(s, d)),
        "op12_two_pass_whitening": lambda s, d: whitening.query(s, documents(s, d, "embeddings")),
        "op13_radix_prefix_trie": lambda s, d: prefix_trie.query(s, documents(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_proportional_interleaving": sharding.SQL, "op3_lsh_forest_near_dedup": near_dedup.SQL, "op8_line_dedup_runs": line_dedup.SQL, "op10_containment_search": decontamination.SQL, "op13_radix_prefix_trie": prefix_trie.SQL}
