"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from rungmill.llm import abuse, containers, defective_pairs, formatting_copies, leaked_passages, linking, near_duplicates, quota_sampling, truncation

_PARTS = (near_duplicates, formatting_copies, defective_pairs, linking, quota_sampling, truncation, containers, leaked_passages, abuse)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _PARTS for k, q in m.ORACLE.items()}
