"""All registered queries of the engine's own operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

from podium.catalog import alignment, evaluation, geometry, ordering, pictures, relational, sources, speech, text, vectors

_PARTS = (ordering, alignment, text, evaluation, vectors, geometry, pictures, speech, sources, relational)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
