"""Registers the queries of this subpackage."""

from __future__ import annotations

from carrisk.llm import bpe, decontaminate, id_files, near_dedup, ngram_join, pii, quality, spelling, substring_dedup, token_counts, urls, vector_codes, warc  # noqa: F401
from carrisk.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
