"""Structured Streaming jobs (availableNow triggers)."""
