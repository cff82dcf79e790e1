"""Structured Streaming pipelines: ingest, consume, and live minute counts."""
