"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    chat, decontamination, fingerprints, hard_negatives, language, materialise, near_duplicates, nearest, packing, spelling, suffix_tree,
    token_counts, urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_near_duplicates": near_duplicates.op4_near_duplicates,
        "op5_language_id": language.op5_language_id,
        "op6_training_order": materialise.op6_training_order,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_url_filters": urls.op9_url_filters,
        "op10_lm_scoring": suffix_tree.op10_lm_scoring,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_spelling": spelling.op12_spelling,
        "op13_nearest": nearest.op13_nearest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL,
        "op4_near_duplicates": near_duplicates.SQL,
        "op8_chat_formatting": chat.SQL,
        "op9_url_filters": urls.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_spelling": spelling.SQL,
    }
