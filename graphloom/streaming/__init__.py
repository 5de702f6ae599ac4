"""Structured Streaming: event windows and incremental snapshots."""
