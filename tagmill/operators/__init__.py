"""Barcode graph and deduplication operators."""
