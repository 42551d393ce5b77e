"""All core queries by name."""

from __future__ import annotations

from poolcraft.queries import general, history, relational, runs, texts

_MODULES = (general, texts, history, relational, runs)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "first_run_cut"
