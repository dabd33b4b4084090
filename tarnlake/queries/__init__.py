"""Every registered query of the library, by key, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from tarnlake.queries import documents, embeddings, pictures, reports, splits

MODULES = (embeddings, documents, splits, reports, pictures)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
