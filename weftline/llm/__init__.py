"""Operators on the texts of training data; nothing else in the library imports this package."""
