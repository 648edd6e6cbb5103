"""All queries of the core and their SQL."""

from __future__ import annotations

from tidende.plans import corpora, linking, maps, storage, texts

_PARTS = (linking, texts, maps, corpora, storage)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
