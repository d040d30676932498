"""Structured Streaming ingestion, beyond the batch operators."""
