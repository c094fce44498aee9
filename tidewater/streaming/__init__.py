"""Incremental work lists and live streams."""
