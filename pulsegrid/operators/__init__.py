"""DataFrame operators over the archive."""
