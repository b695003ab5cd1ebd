"""Whole runs: from a folder of dumps to published output."""
