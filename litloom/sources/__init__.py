"""Parquet store, metadata and page sources, shared storage."""
