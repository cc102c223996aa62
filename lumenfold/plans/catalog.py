"""Queries of the engine over the shared tables, each with its SQL for DuckDB."""

from lumenfold.plans import custody_queries, decision_queries, evaluation_queries, frame_queries, join_queries, matching_queries, phrase_queries, source_queries, table_queries, text_queries, vector_queries

_MODULES = [text_queries, table_queries, matching_queries, join_queries, decision_queries, custody_queries, evaluation_queries, source_queries, vector_queries, frame_queries, phrase_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
