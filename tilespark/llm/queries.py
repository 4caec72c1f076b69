"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, html_extract, line_dedup, mixing, near_dedup, outliers, packing, pii, quality, recompression


def queries() -> dict:
    return {
        "op1_quality_compression": quality.op1_quality_compression,
        "op2_pii_surrogates": pii.op2_pii_surrogates,
        "op3_robust_outliers": outliers.op3_robust_outliers,
        "op4_recompression": recompression.op4_recompression,
        "op5_packing": packing.op5_packing,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_recompression": recompression.SQL, "op6_embedding_dedup": embedding_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op10_near_dedup": near_dedup.SQL}
