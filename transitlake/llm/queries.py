"""Queries and oracle SQL of the operators of this subpackage.

All modules are imported when this one is, so that a library missing for any of
them shows where this module is imported."""

from __future__ import annotations

from transitlake.llm import (collocations, decontamination, html_mincut, line_dedup, quality_classifier, quality_ledger, secret_scan,
                             sentencepiece_codec, simhash_trie, substring_dedup, token_alignment, toxicity, url_filter)

MODULES = [sentencepiece_codec, substring_dedup, toxicity, line_dedup, url_filter, secret_scan, quality_ledger, html_mincut,
           decontamination, simhash_trie, token_alignment, quality_classifier, collocations]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
