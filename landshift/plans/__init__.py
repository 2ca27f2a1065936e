"""Composite jobs, test fixtures and the query registry."""
