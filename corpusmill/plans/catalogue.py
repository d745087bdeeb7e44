"""The registered queries and their SQL."""

from __future__ import annotations

from corpusmill.plans import file_queries, record_queries, score_queries, search_queries, sequence_queries, source_queries, sql_queries, stream_queries, text_queries
from corpusmill.plans.text_queries import clean_chunk_summary as clean_chunk_summary

_MODULES = (text_queries, sequence_queries, score_queries, source_queries, record_queries, search_queries, file_queries, stream_queries, sql_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
