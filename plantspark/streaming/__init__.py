"""Structured Streaming: file ingest, newest row per key, windows over events."""
