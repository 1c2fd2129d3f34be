"""Structured Streaming forms of the pipeline and its rates."""
