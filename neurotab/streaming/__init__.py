"""Structured Streaming jobs: windowed signal features, scoring, job status."""
