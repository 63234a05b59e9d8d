"""Composite flows, views over the test tables, and the query registry."""
