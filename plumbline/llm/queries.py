"""The registered query of each operator, and its SQL where SQL can express it."""
from __future__ import annotations

import importlib

#: Modules of this subpackage that register a query: each has NAME, query() and perhaps ORACLE_SQL.
MODULES = ("ann", "bpe", "chat_format", "decontaminate", "html_extract", "license_scan", "line_dedup", "quality", "simhash", "url_filter")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"plumbline.llm.{_name}")
    QUERIES[_module.NAME] = _module.query
    if getattr(_module, "ORACLE_SQL", None):
        ORACLE_SQL[_module.NAME] = _module.ORACLE_SQL

import corpus_pipeline  # noqa: E402  the pipeline belongs to this subpackage

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
