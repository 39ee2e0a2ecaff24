"""Structured Streaming forms of operators."""
