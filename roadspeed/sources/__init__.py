"""Readers and writers for the landed and derived tables."""
