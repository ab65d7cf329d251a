"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.queries_text import QUERIES as _TEXT
from tidemark.llm.queries_text import SQL as _SQL

QUERIES = {**_TEXT, "pipeline": corpus_pipeline.run}
SQL = dict(_SQL)
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
