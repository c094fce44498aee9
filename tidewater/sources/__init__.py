"""Schemas, feeds and tables."""
