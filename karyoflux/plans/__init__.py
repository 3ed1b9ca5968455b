"""Registered queries over the parquet tables and the SQL they are compared with."""
