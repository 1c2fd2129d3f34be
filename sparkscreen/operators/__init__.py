"""Screening stages, response redaction, metrics and tuning."""
