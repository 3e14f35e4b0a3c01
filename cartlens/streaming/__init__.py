"""Structured Streaming versions of the monitors and the business event intake."""
