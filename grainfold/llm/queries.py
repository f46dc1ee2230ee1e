"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from grainfold.llm import bpe, chunk_bpe, exact_dedup, jaccard_join, line_dedup, lm_scores, packing, periodic_runs, prefix_trie, quality_classifier, quality_rules, span_dedup, token_counts


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_suffix_dedup": span_dedup.op2,
        "op3_quality_classifier": quality_classifier.op3,
        "op4_quality_rules": quality_rules.op4,
        "op5_lm_scores": lm_scores.op5,
        "op6_jaccard_join": jaccard_join.op6,
        "op7_exact_dedup": exact_dedup.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_byte_bpe": bpe.op9,
        "op10_token_counts": token_counts.op10,
        "op11_chunk_bpe": chunk_bpe.op11,
        "op12_periodic_runs": periodic_runs.op12,
        "op13_prefix_trie": prefix_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": span_dedup.ORACLE,
        "op4_quality_rules": quality_rules.ORACLE,
        "op5_lm_scores": lm_scores.ORACLE,
        "op6_jaccard_join": jaccard_join.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
