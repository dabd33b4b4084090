"""The queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("packing", "toxicity", "urls", "lines", "mixing", "quality", "substrings", "jaccard", "embeddings", "pii")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tarnlake.llm.{name}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
