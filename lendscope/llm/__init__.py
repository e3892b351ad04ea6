"""Operators for preparing training data: scans, deduplication, scoring and packing."""
