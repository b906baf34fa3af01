"""Operators for preparing training corpora at scale. Nothing outside imports this package."""
