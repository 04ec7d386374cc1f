"""Structured Streaming ingest of run metrics."""
