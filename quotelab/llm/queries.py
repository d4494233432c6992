"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quotelab.llm import debruijn, decontaminate, gnat, jaccard, language, maxent, packing, quality, repair, secret_scan, suffixes, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_winnowing_decontamination": decontaminate.op1_winnowing_decontamination,
        "op2_bounded_packing": packing.op2_bounded_packing,
        "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
        "op4_debruijn_substring_dedup": debruijn.op4_debruijn_substring_dedup,
        "op5_fourier_quality": quality.op5_fourier_quality,
        "op6_impact_top_k": topk.op6_impact_top_k,
        "op7_warc_round_trip": warc.op7_warc_round_trip,
        "op8_difference_cover_dedup": suffixes.op8_difference_cover_dedup,
        "op9_kneser_ney_language": language.op9_kneser_ney_language,
        "op10_maxent_scores": maxent.op10_maxent_scores,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_guess_cost_secrets": secret_scan.op12_guess_cost_secrets,
        "op13_gnat_hard_negatives": gnat.op13_gnat_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_winnowing_decontamination": decontaminate.SQL,
        "op3_ngram_jaccard_join": jaccard.SQL,
        "op4_debruijn_substring_dedup": debruijn.SQL,
        "op6_impact_top_k": topk.SQL,
        "op7_warc_round_trip": warc.SQL,
        "op11_conversation_repair": repair.SQL,
        "op13_gnat_hard_negatives": gnat.SQL,
    }
