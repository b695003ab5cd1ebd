"""Dump files: listing, reading, staging, writing."""
