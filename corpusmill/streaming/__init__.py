"""Structured Streaming operators over commands and lifecycle events."""
