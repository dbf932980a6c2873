"""Queries and SQL of all operators of this subpackage."""

from __future__ import annotations

from . import byte_bpe, disclosure, embedding_forest, packing, periodic_runs, perplexity, quality_knn, simhash_anchor, suffix_dedup, token_rollup, toxicity, warc, whitening

_MODULES = [suffix_dedup, embedding_forest, perplexity, toxicity, warc, token_rollup, quality_knn, packing, byte_bpe, simhash_anchor, whitening, periodic_runs, disclosure]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
