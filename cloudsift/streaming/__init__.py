"""Structured Streaming forms of the ingest and of windowed hunts."""
