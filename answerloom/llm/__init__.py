"""Operators that prepare a corpus for training. Nothing else in the library imports this package."""
