"""Streaming ingest and windowed rollups."""
