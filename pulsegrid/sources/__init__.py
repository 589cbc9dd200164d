"""Readers: wire formats and views that look like the archive."""
