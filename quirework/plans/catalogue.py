"""All queries of the core with their SQL twins."""

from quirework.plans import chains, pages, problems, relations, streams

_MODULES = [problems, pages, streams, relations, chains]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
