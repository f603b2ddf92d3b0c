"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, importance, language_id, media_ts, mixing, ngram_join, pii, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_importance": importance.op2_importance,
    "op3_language_id": language_id.op3_language_id,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_pii": pii.op5_pii,
    "op6_media_ts": media_ts.op6_media_ts,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLES: dict[str, str] = {
    "op7_decontaminate": decontaminate.OP7_SQL,
}
