"""All queries outside the training-data subpackage."""

from . import kind_queries, kind_sql, report_queries, stream_queries, tabular, text_queries, vector_queries

_MODULES = (tabular, text_queries, stream_queries, vector_queries, kind_queries, kind_sql, report_queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
