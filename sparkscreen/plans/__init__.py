"""Pipelines: stages folded into one decision for each request."""
