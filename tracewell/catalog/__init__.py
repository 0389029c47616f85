"""The catalogue: a query for each operator, over the driver's tables, and the same in SQL."""

from __future__ import annotations

from . import graph, index, ranking, text

BOOKS = (text.BOOK, ranking.BOOK, graph.BOOK, index.BOOK)
QUERIES = {name: query for book in BOOKS for name, query in book.queries.items()}
ORACLE_SQL = {name: sql for book in BOOKS for name, sql in book.sql.items()}
