"""Incremental forms of the operators for Structured Streaming."""
