"""Queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fair_mix, gif_media, graph_dedup, language_id, license_scan, minhash_dedup, pii_surrogates, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": pii_surrogates.op1_pii_surrogates,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_nbsvm_quality": quality.op3_nbsvm_quality,
        "op4_graph_dedup": graph_dedup.op4_graph_dedup,
        "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
        "op6_gif_media": gif_media.op6_gif_media,
        "op7_language_id": language_id.op7_language_id,
        "op8_toxic_segments": toxicity.op8_toxic_segments,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_fair_mix": fair_mix.op10_fair_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_graph_dedup": graph_dedup.ORACLE,
        "op5_minhash_dedup": minhash_dedup.ORACLE,
        "op9_license_scan": license_scan.ORACLE,
        "op10_fair_mix": fair_mix.ORACLE,
    }
