"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (queries_alignment, queries_centroids, queries_chat, queries_classify, queries_contamination, queries_jaccard, queries_mixing,
               queries_neighbours, queries_quality, queries_repeats, queries_scoring, queries_warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": queries_classify.op1_language,
    "op2_lm_score": queries_scoring.op2_lm_score,
    "op6_decontaminate": queries_contamination.op6_decontaminate,
    "op7_neighbours": queries_neighbours.op7_neighbours,
    "op4_jaccard_join": queries_jaccard.op4_jaccard_join,
    "op8_repeats": queries_repeats.op8_repeats,
    "op10_toxicity": queries_classify.op10_toxicity,
    "op3_fair_mix": queries_mixing.op3_fair_mix,
    "op5_warc": queries_warc.op5_warc,
    "op9_chat_format": queries_chat.op9_chat_format,
    "op11_centroids": queries_centroids.op11_centroids,
    "op12_alignment": queries_alignment.op12_alignment,
    "op13_quality": queries_quality.op13_quality,
}
ORACLES: dict[str, str] = {
    "op6_decontaminate": queries_contamination.SQL,
    "op3_fair_mix": queries_mixing.SQL,
    "op5_warc": queries_warc.SQL,
    "op9_chat_format": queries_chat.SQL,
    "op11_centroids": queries_centroids.SQL,
}
