"""Readers and writers: request bodies, turns, fixtures, audit records."""
