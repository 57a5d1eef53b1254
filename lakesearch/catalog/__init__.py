from lakesearch.catalog.registry import QUERIES, SQL
from lakesearch.catalog import collection, ingest, measures, retrieval, scalars, search, sources, streams, tables  # noqa: F401

__all__ = ["QUERIES", "SQL"]
