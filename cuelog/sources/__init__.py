"""Readers and writers for the data model."""
