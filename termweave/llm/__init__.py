"""Operators for preparing training corpora: filtering, deduplication, mixing and packing."""
