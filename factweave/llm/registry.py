"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import bpe, fingerprint, html, jaccard, licenses, lines, packing, quality, suffixes, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bit_sliced_top_k": topk.op1_bit_sliced_top_k,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_packing": packing.op3_packing,
        "op4_quality": quality.op4_quality,
        "op5_suffix_array": suffixes.op5_suffix_array,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_html_text": html.op8_html_text,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_bit_sliced_top_k": topk.ORACLE_SQL,
        "op2_license_scan": licenses.ORACLE_SQL,
        "op5_suffix_array": suffixes.ORACLE_SQL,
        "op6_line_dedup": lines.ORACLE_SQL,
        "op10_jaccard_join": jaccard.ORACLE_SQL,
    }
