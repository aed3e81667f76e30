"""Incremental arrival of targets."""
