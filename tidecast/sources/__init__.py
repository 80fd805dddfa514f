"""Schemas, scans, sinks, and the binding of the demand tables to the supplied parquet tables."""
