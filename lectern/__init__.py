"""Lectern: Spark jobs for versioned text collections.

Catalog queries, rankings, ingestion, matching, publishing and search over
collections of works, written as DataFrame and SQL plans.
"""
