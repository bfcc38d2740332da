"""Composite jobs: the only batch code that writes tables."""
