"""Readers, adapters onto the canonical schemas, and writers."""
