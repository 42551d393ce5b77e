"""Queries of problems 1 and 4 to 9."""

from __future__ import annotations

from poolcraft.llm import (
    q1_personal,
    q4_cutoff,
    q5_near_duplicates,
    q6_residue,
    q7_tokens,
    q8_mixing,
    q9_subjects,
)

_MODULES = (q1_personal, q4_cutoff, q5_near_duplicates, q6_residue, q7_tokens, q8_mixing, q9_subjects)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
