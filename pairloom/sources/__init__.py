"""Readers, writers, catalogues and fingerprints."""
