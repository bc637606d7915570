"""Structured Streaming forms of the audit log, the daily series and the notifications."""
