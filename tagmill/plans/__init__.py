"""Pipelines and benchmark tables."""
