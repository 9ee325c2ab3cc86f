"""Composite entry points."""
