"""All registered queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

PARTS = ("series_plans", "relational_plans", "text_plans", "cohort_plans", "stream_plans", "extraction_plans", "model_plans", "evaluation_plans", "source_plans", "question_plans", "feature_plans")
QUERIES: dict = {}
ORACLE: dict = {}
for _part in PARTS:
    _module = import_module(f"{__package__}.{_part}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
