"""All registered queries of this package and their oracle SQL."""

from __future__ import annotations

from rollcall.llm import (best_fit_packing, bpe_encoding, chat_format, collocations, exact_dedup, language_id, lm_scoring, ngram_join, quality_classifier,
                          quality_rules, source_mixing, warc, whitening)

_MODULES = [quality_rules, ngram_join, best_fit_packing, exact_dedup, chat_format, language_id, lm_scoring, source_mixing, warc,
            quality_classifier, whitening, collocations, bpe_encoding]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
