"""Column functions: text views of requests, redaction, small numeric helpers."""
