"""All registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

AREAS = ("language", "passages", "lines", "darts", "search", "vectors", "mixing", "toxicity", "chat", "pieces", "audit", "fingerprints", "spelling")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _area in AREAS:
    _module = import_module(f"faultline.llm.{_area}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
