"""The queries over the given tables, by name, and the same in SQL."""

from . import evaluation, ingest, parsing, ranking, relational, rules, shaping, texts, vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (vectors, texts, relational, ranking, rules, shaping, evaluation, ingest, parsing):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
