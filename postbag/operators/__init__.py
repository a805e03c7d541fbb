"""Operators: each takes and returns a lazy ``DataFrame``."""
