"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from leadlake.llm import alignment, byte_bpe, conversations, embedding_dedup, jaccard_join, langid, line_dedup, mixing, packing, pii, quality, secret_scan, toxicity

_MODULES = (pii, byte_bpe, secret_scan, langid, toxicity, quality, line_dedup, mixing, embedding_dedup, jaccard_join, packing, alignment, conversations)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
