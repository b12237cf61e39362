"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontam, filter_audit, langid, license_scan, near_dedup, packing, quality, sentence_dedup, suffix_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_license_scan": license_scan.op2_license_scan,
        # the operator's production query; op3_sentence_dedup is the same by whole sentences, which SQL can state
        "op3_passage_dedup": sentence_dedup.op3_passage_dedup,
        "op3_sentence_dedup": sentence_dedup.op3_sentence_dedup,
        "op4_decontamination": decontam.op4_decontamination,
        "op4_decontamination_near": decontam.op4_decontamination_near,
        "op5_packing": packing.op5_packing,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat_format": chat.op9_chat_format,
        "op10_top_k": topk.op10_top_k,
        "op11_quality": quality.op11_quality,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sentence_dedup": sentence_dedup.OP3_SQL,
        "op4_decontamination": decontam.OP4_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op10_top_k": topk.OP10_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
