"""Readers, payload parsing, upserts and writers."""
