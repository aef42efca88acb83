"""The numbered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tagloom.llm import kneser_ney, packing, piece_bpe, quality_rules, rans, setjoin, surrogates, topk, toxicity, url_rules


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_classifier": kneser_ney.op2_quality_classifier,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_url_filters": url_rules.op4_url_filters,
        "op5_token_ids": rans.op5_token_ids,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_surrogates": surrogates.op7_surrogates,
        "op8_ngram_jaccard_join": setjoin.op8_ngram_jaccard_join,
        "op9_sentencepiece": piece_bpe.op9_sentencepiece,
        "op10_exact_top_k": topk.op10_exact_top_k,
    }


def oracle_sql() -> dict:
    return {
        "op6_quality_rules": quality_rules.op6_sql(),
        "op10_exact_top_k": topk.op10_sql(),
    }
