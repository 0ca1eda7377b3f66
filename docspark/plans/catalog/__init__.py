"""Registered queries, one per operator or pipeline."""

from docspark.plans.catalog import documents, ingest, keyed_tables, learning, pipelines, reading
from docspark.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "documents", "ingest", "keyed_tables", "learning", "pipelines", "reading"]
