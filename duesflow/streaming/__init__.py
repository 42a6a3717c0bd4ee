"""Incremental ingest of monthly drops."""
