"""Queries of the training-data operators by name, and their DuckDB twins."""

from __future__ import annotations

from lexmill.llm import bpe, decontaminate, fingerprints, language, neardup, pii, quality, repeats, tokencount, urlfilter

QUERIES = {
    "op1_repeats": repeats.query,
    "op2_bpe": bpe.query,
    "op3_token_counts": tokencount.query,
    "op4_language": language.query,
    "op5_url_filter": urlfilter.query,
    "op6_neardup": neardup.query,
    "op7_pii": pii.query,
    "op8_decontaminate": decontaminate.query,
    "op9_fingerprints": fingerprints.query,
    "op10_quality": quality.query,
}

ORACLE_SQL = {
    "op1_repeats": repeats.oracle(),
    "op6_neardup": neardup.oracle(),
    "op8_decontaminate": decontaminate.oracle(),
    "op9_fingerprints": fingerprints.oracle(),
}
