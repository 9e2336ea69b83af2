"""All queries of the engine, by name."""

from .queries import base, documents, formats, lifecycle, relations, rounds, runs, scalars

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "flagship", "formats", "lifecycle", "relations", "rounds", "runs", "scalars"]

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
flagship = documents.flagship
