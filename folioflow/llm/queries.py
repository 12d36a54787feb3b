"""Registered queries of the problems, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import confusables, language, mixing, pairs, pii, scans, sentences, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": language.p1_found,
    "p1_segments": language.p1_segments,
    "p2_found": sentences.p2_found,
    "p3_found": scans.p3_found,
    "p3_paragraphs": scans.p3_paragraphs,
    "p4_found": confusables.p4_found,
    "p4_normalized": confusables.p4_normalized,
    "p4_words": confusables.p4_words,
    "p5_found": pairs.p5_found,
    "p6_ids": tokens.p6_ids,
    "p7_mix": mixing.p7_mix,
    "p7_report": mixing.p7_report,
    "p8_found": pii.p8_found,
    "p8_redacted": pii.p8_redacted,
}

#: The results need trained models, tokenizers or rule cascades; they are tested in tests/llm.
ORACLES: dict[str, str] = {}
