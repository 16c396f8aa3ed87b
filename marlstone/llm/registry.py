"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

from .oracle import ORACLE

#: query -> module that holds a function of that name
MODULES = {
    "op1_quality_cnn": "quality",
    "op10_ngram_jaccard": "ngram_join",
    "op2_webp_media": "media",
    "op3_syncmer_fingerprints": "syncmers",
    "op4_mph_token_index": "token_index",
    "op5_tree_scored_html": "html_text",
    "op6_secret_worklist": "secrets",
    "op7_seekable_warc": "warc",
    "op8_pareto_mix": "mixing",
    "op9_pattern_packing": "packing",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
