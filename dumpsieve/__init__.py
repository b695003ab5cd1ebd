"""Filtering and reshaping of zstd-compressed NDJSON dumps on Spark."""
