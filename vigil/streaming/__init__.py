"""Structured Streaming: incremental rollups (M1), exact late-data recompute (M2)
and streaming ingest (M3)."""
