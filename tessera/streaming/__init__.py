"""Incremental ingest of snapshots with Structured Streaming; an addition of this engine."""
