"""Scalar column functions; every one is a plain Catalyst expression."""
