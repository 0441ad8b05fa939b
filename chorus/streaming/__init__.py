"""Structured Streaming jobs: incremental page ingest (ST1) and running counts (ST2)."""
