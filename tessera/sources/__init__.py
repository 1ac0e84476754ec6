"""Readers, writers and the domain frames derived from the driver tables."""
