"""Structured Streaming forms: event windows and incremental sinks (extensions of the batch operators)."""
