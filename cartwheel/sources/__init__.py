"""Readers, writers and the canonical star-schema views over the driver tables."""
