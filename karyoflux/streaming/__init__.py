"""Incremental ingest of arriving samples."""
