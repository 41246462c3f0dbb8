"""Structured Streaming jobs: ingest, rules, incremental history, rate checks."""
