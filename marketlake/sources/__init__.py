"""Scans and landing writers."""
