"""Structured Streaming forms: debounce, outbox, idempotent replay."""
