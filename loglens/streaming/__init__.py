"""Ingestion of growing logs with Structured Streaming."""
