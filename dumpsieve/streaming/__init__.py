"""Incremental runs as a stream of newly arrived files."""
