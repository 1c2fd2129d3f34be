"""Schemas of requests, decisions and audit records."""

from __future__ import annotations

PART = "struct<type: string, text: string, image_url: struct<url: string, detail: string>>"
MESSAGE = f"struct<role: string, text: string, parts: array<{PART}>>"
MESSAGES = f"array<{MESSAGE}>"
RECORD = "struct<entity_type: string, offset: int, length: int>"
#: One stage's finding: what it decided, and the messages it rewrote stand in a column of their own.
FINDING = "struct<action: string, reason: string, code: string, entities: array<string>, score: double, detail: string>"
REQUEST_SCHEMA = f"request_id string, received_at timestamp, provider string, model string, stream boolean, messages {MESSAGES}, extra map<string, variant>"
AUDIT_SCHEMA = (
    "timestamp string, request_id string, decision string, stage string, reason string, code string, score double, model string, "
    "provider string, message_count int, pii_entities_found array<string>, latency_pipeline_ms double, latency_total_ms double"
)
ROLES = ("system", "user", "assistant", "tool")
