"""Operators on training text: scoring, tokens, packing, secrets, copies, vectors and pages."""
