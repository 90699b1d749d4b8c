"""Incremental ingestion with Structured Streaming (availableNow daily loads)."""
