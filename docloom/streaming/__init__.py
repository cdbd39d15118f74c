"""Streaming ingestion of document files."""
