"""Registered queries over the standard tables, and the SQL that each must equal."""

from . import changes, corrections, exchange, extraction, matching, measures, more, pricing, reads, registers, rulebook, similarity, texts

_MODULES = (pricing, reads, texts, matching, measures, changes, extraction, more, exchange, similarity, registers, rulebook, corrections)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
