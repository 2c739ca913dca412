"""Operators that prepare texts and records for training models. Nothing outside imports this package."""
