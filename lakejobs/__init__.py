"""Lakehouse jobs on Spark: ingest, silver/gold layers, vectors, table-metadata
inventory, platform telemetry, catalogue audit and ad-hoc SQL."""

__version__ = "0.1.0"
