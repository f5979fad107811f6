"""Incremental runs with memory."""
