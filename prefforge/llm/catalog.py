"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from prefforge.llm import (
    queries_alignment, queries_bpe, queries_exact_dedup, queries_line_dedup, queries_mixing, queries_packing, queries_periodic, queries_pii, queries_quality, queries_simhash, queries_suffix_dedup, queries_topk,
    queries_toxicity,
)

_MODULES = (
    queries_suffix_dedup, queries_simhash, queries_pii, queries_mixing, queries_line_dedup, queries_exact_dedup, queries_toxicity, queries_topk, queries_bpe, queries_quality, queries_packing, queries_periodic,
    queries_alignment,
)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
