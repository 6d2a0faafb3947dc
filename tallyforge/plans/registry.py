"""All registered queries of the core library, each with its SQL over the same tables where SQL can express it."""

from __future__ import annotations

from . import file_queries, monitor_queries, page_queries, record_queries, table_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (text_queries, table_queries, monitor_queries, page_queries, record_queries, file_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
