"""Structured Streaming: event ingest, decayed interest, tumbling and sliding grids, sessions."""
