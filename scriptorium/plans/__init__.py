"""Queries that apply the operators to the test tables, with their SQL for DuckDB."""

from scriptorium.plans import extras, layouts, places, relations, scalars, structure

QUERIES = scalars.QUERIES | relations.QUERIES | layouts.QUERIES | extras.QUERIES | places.QUERIES | structure.QUERIES
ORACLE = scalars.ORACLE | relations.ORACLE | layouts.ORACLE | extras.ORACLE | places.ORACLE | structure.ORACLE
