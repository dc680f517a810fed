"""Structured Streaming forms of the polling and checkpoint jobs."""
