"""Structured Streaming operators; those without state also work on batch frames."""
